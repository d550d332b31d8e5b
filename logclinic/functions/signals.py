"""Named failure signals as native Spark predicates.

Each signal is a set of alternative phrases searched in the pooled text of a source.  A signal becomes one
``rlike`` with a literal pattern (compiled once per task) behind a cheap ``contains`` guard on the case-folded
text, so a text that carries none of the guard words never reaches the regular-expression engine.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s under (?U) lacks the four separators 1C-1F that count as white space here.
WHITE = r"[\s\x1c-\x1f]"
_JAVA_FLAGS = "(?iUd)"

# --- fixed values -----------------------------------------------------------------------------------------
# Alternatives per signal.  A blank stands for one or more white-space characters (line breaks included),
# \x20 for a single plain space; everything else is ordinary regular-expression syntax, case-insensitive.
# Signals in HEURISTIC weigh 15, all others are exact signatures and weigh 40.
_Q = "[`'\"][^`'\"]+[`'\"]"
DRIVER_HINTS = [
    r"call to \S+\.collect",
    r"\btoPandas\b",
    r"spark\.driver\.memory",
    r"driver stack trace",
    r"driver (?:node|process|oom|out of memory)",
    r"out of memory on the driver",
]
SIGNALS: dict[str, list[str]] = {
    "resolved_column_not_found": [
        r"\[RESOLVED_COLUMN_NOT_FOUND\]",
        r"\[UNRESOLVED_COLUMN",
        rf"column {_Q} cannot be resolved",
        rf"cannot resolve {_Q} in given schema",
        rf"cannot resolve {_Q} given input columns",
    ],
    "datatype_mismatch": [r"\[DATATYPE_MISMATCH\]", "data type mismatch"],
    "unexpected_column": [
        r"\[TOO_MANY_DATA_COLUMNS\]",
        "too many data columns",
        r"\[EXTRA_COLUMNS\]",
        "cannot write extra columns",
    ],
    "ambiguous_reference": [
        r"\[AMBIGUOUS_REFERENCE",
        rf"reference {_Q} is ambiguous",
        rf"column {_Q} is ambiguous",
        "ambiguous reference to the field",
        "ambiguous column name in the input data",
    ],
    "schema_evolution_blocked": ["a schema mismatch detected when writing"],
    "nested_schema_field_unresolved": [
        r"\[UNRESOLVED_FIELD",
        "cannot be resolved with the struct-type column",
    ],
    "null_constraint_violated": [
        r"\[NOT_NULL_CONSTRAINT_VIOLATION\]",
        "assigning a NULL is not allowed here",
    ],
    "duplicate_keys": ["found duplicate keys"],
    "date_parse_failure": [r"cannot be (cast|converted) to (date|timestamp)\b"],
    "invalid_numeric_value": [
        "cannot be (cast|converted) to (tinyint|smallint|integer|int|bigint|float|double|real|decimal|numeric)",
        r"cannot be cast to [^\n]+ due to an overflow",
        r"\[CAST_OVERFLOW\]",
        r"\[ARITHMETIC_OVERFLOW\]",
    ],
    "merge_cardinality_violation": [
        r"\[MERGE_CARDINALITY_VIOLATION\]",
        "matched a single row from the target table",
    ],
    "table_or_view_not_found": [
        r"\[TABLE_OR_VIEW_NOT_FOUND\]",
        rf"table or view {_Q} not found",
        r"the table or view [^\n]+ cannot be found",
    ],
    "authentication_failure": [
        "authentication failed",
        "authentication error",
        "authentication exception",
        "unauthorized",
        "AuthenticationException",
        r"invalid[_\x20]authentication",
        r"access token[^\n]*(expired|invalid)",
        "HTTP 401",
        "401 unauthorized",
    ],
    "dns_failure": [
        "UnknownHostException",
        "name or service not known",
        "nodename nor servname",
        "dns lookup failed",
    ],
    "permission_denied": [
        "permission denied",
        "access denied",
        r"\[ACCESS_DENIED\]",
        "authori[sz]ation permission denied",
    ],
    "connection_timeout": [
        "connect timed out",
        "connection timed out",
        "ConnectTimeoutException",
        "read timed out",
    ],
    "endpoint_unavailable": [
        "connection refused",
        "remote end (closed|reset)",
        "service unavailable",
        r"\[ENDPOINT_UNAVAILABLE\]",
    ],
    "executor_oom": [
        r"java\.lang\.OutOfMemoryError",
        "insufficient memory",
        "exceeding memory limits",
    ],
    "executor_lost": [
        "ExecutorLostFailure",
        r"Lost executor \d+",
        "executor heartbeat timed out",
    ],
    "task_failure_repeated": [
        r"failed \d+ times, most recent failure",
        r"failed \d+ times; aborting job",
    ],
    "shuffle_fetch_failed": [
        "FetchFailedException",
        "Missing an output location for shuffle",
    ],
    "broadcast_timeout": [
        "BroadcastTimeoutException",
        r"broadcast (channel )?timed? out",
        "error broadcasting",
        r"spark\.sql\.broadcastTimeout",
    ],
    "broadcast_oom": [
        "not enough memory to build and broadcast",
        r"broadcast[^\n]*OutOfMemoryError",
        r"OutOfMemoryError[^\n]*broadcast",
    ],
    "stage_failure": ["job aborted due to stage failure"],
    "data_skew": ["data skew", "skewed (join|partition|keys?|group)"],
    "delta_metadata_changed": ["MetadataChangedException"],
    "delta_protocol_changed": ["ProtocolChangedException"],
    "delta_concurrent_transaction": ["ConcurrentTransactionException"],
    "delta_concurrent_conflict": [
        "ConcurrentAppendException",
        "ConcurrentDeleteDeleteException",
        "ConcurrentWriteException",
        "DeltaConcurrentModificationException",
    ],
    "delta_merge_fields_failed": [r"\[DELTA_FAILED_TO_MERGE_FIELDS\]", "failed to merge fields"],
    "delta_not_a_table": ["is not a Delta table"],
    "invalid_partition": [
        r"\[INVALID_PARTITION_COLUMN",
        r"\[PARTITION_WITH_NESTED_COLUMN",
        r"cannot use [^\n]+ for partition column",
        "partition clause cannot contain the non-partition column",
        "invalid partitioning:",
    ],
    "small_files": [
        "too many (small )?files",
        "small files? (problem|issue|detected)",
        "number of files (is )?(too )?(high|large|many)",
    ],
    "excessive_shuffle": [
        "excessive shuffle",
        "shuffle (data )?(size|volume) (is )?(too )?(high|large)",
        "shuffle partition count (is )?(too )?(high|low)",
    ],
    "missing_partition_pruning": [
        "partition pruning (was )?(not|never) (applied|pushed|enabled)",
        "full (table )?scan (detected|on non-partitioned|of partition)",
        "missing partition (filter|pruning)",
    ],
    "broadcast_size_exceeded": [
        "broadcast (table )?(size|data) (exceeds|exceeded|is (too )?(large|big))",
        "autoBroadcastJoinThreshold",
        "too large to broadcast",
        r"broadcast[^\n]*(threshold|exceeded)",
    ],
    "adf_linked_service_error": [
        r"linked service[^\n]*(failed|error|invalid|unable|cannot|not found)",
        "fail(ed|ure)? to connect to (the )?linked service",
        "cannot connect to (the )?linked service",
        "LinkedServiceConnectionFailed",
    ],
    "adf_integration_runtime_unavailable": [
        r"self[-\x20]?hosted integration runtime",
        "SelfHostedIntegrationRuntime",
        r"integration runtime[^\n]*(not available|unavailable|offline|not running|cannot be reached|is down|no active node)",
        "integration runtime node is unreachable",
    ],
    "adf_dataset_not_found": [
        r"(dataset|data set|blob path|file path|source path)[^\n]*\bnot found",
        "DataFactoryDatasetNotFound",
        "DatasetNotFound",
        "(cannot|could not) find the dataset",
    ],
    "adf_activity_timeout": [
        r"activity[^\n]*(timed?\s*out|exceeded its timeout)",
        "ActivityTimeout",
        "the activity did not complete within the configured timeout",
    ],
    "adf_parameter_error": [
        "missing required parameters?",
        "required parameters? (is|are) (missing|not (found|provided|specified))",
        rf"parameter {_Q} (is not found|does not exist)",
        "template parameters? validation failed",
        "InvalidTemplate",
    ],
    "adf_throttling": [
        "too many requests",
        "HTTP 429",
        "throttl(ed|ing)",
        "exceeded the (allowed )?(rate|request) limit",
    ],
}
# driver_oom and stacktrace_present do not fit the phrase form: the first needs an out-of-memory token and a driver
# hint anywhere in the text, the second is case-sensitive and anchored at line starts.
OOM_TOKEN = "OutOfMemoryError"
STACK_PATTERN = r"^\s+at\s+.+\(.+:\d+\)|Traceback\x20\(most\x20recent\x20call\x20last\)"
HEURISTIC = {
    "driver_oom",
    "broadcast_timeout",
    "data_skew",
    "delta_not_a_table",
    "small_files",
    "excessive_shuffle",
    "missing_partition_pruning",
    "broadcast_size_exceeded",
    "stacktrace_present",
}
# ----------------------------------------------------------------------------------------------------------

ALL_SIGNALS: list[str] = sorted([*SIGNALS, "driver_oom", "stacktrace_present"])
EXACT: list[str] = [s for s in ALL_SIGNALS if s not in HEURISTIC]
#: Two helper facts that make driver_oom additive over pieces of one source.
OOM_BIT, HINT_BIT = len(ALL_SIGNALS), len(ALL_SIGNALS) + 1


def expand(phrase: str, white: str = WHITE) -> str:
    """Turn the blank notation into a regular expression; ``white`` is the white-space class."""
    return phrase.replace(r"\s*", white + "*").replace(" ", white + "+")


def pattern(phrases: list[str], white: str = WHITE) -> str:
    return "|".join(expand(p, white) for p in phrases)


def guard_words(phrase: str) -> list[str]:
    """Literal runs every match of ``phrase`` must contain, lower-cased, longest first."""
    text = phrase
    while re.search(r"\([^()]*\)", text):  # groups may be optional or alternative
        text = re.sub(r"\([^()]*\)[?*]?", "\0", text)
    text = re.sub(r"\[[^\]]*\][+*?]?(?!\])", lambda m: "\0" if not m.group().startswith(r"\[") else m.group(), _mask(text))
    text = re.sub(r"\\[bdsS][+*]?|\\x20", "\0", text)
    text = re.sub(r".[?*]", "\0", text)
    text = text.replace("\\.", ".").replace("\\", "")
    runs = re.split("[\0\1 +]", text)
    words = {r.lower() for r in runs if len(r) >= 3}
    return sorted(words, key=lambda w: (-len(w), w))


def _mask(text: str) -> str:
    """Escaped brackets are literals; hide them from the class remover."""
    return text.replace(r"\[", "\1").replace(r"\]", "\1")


def folded(text: Column) -> Column:
    """Lower-case text in which the four non-ASCII letters that case-insensitively equal i, s or k are folded."""
    odd, plain = "İıſK", "iisk"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.lower(F.translate(text, odd, plain))
    )


# Conditions are built as SQL text: there are hundreds of small terms, and one parse is far cheaper than one call each.


def _raw(regex: str) -> str:
    """SQL literal of a regular expression, quotes written as escapes the expression engine knows."""
    return "r'" + regex.replace("'", r"\x27") + "'"


def _guarded(text: str, low: str, phrases: list[str]) -> str:
    guards = {" AND ".join(f"contains({low}, '{w}')" for w in guard_words(p)) for p in phrases}
    guard = " OR ".join(f"({g})" for g in sorted(guards))
    return f"(({guard}) AND {text} RLIKE {_raw(_JAVA_FLAGS + pattern(phrases))})"


def signal_condition(name: str, text: str, low: str) -> str:
    """SQL condition: does ``text`` show the signal?  ``low`` names the folded text."""
    if name == "driver_oom":
        return f"({oom_condition(low)} AND {_guarded(text, low, DRIVER_HINTS)})"
    if name == "stacktrace_present":
        stack = STACK_PATTERN.replace(r"\s", WHITE)
        return f"(contains({text}, '(') AND {text} RLIKE {_raw('(?mUd)' + stack)})"
    return _guarded(text, low, SIGNALS[name])


def oom_condition(low: str) -> str:
    return f"contains({low}, '{OOM_TOKEN.lower()}')"


@cache
def _gated() -> dict[str, dict[str, list[str]]]:
    """Phrases of all signals by gate: a few short texts so that every phrase needs one of them, largest groups first.

    A text that lacks a gate skips all its phrases with one search.
    """
    left = {(name, p): guard_words(p) for name, alternatives in SIGNALS.items() for p in alternatives}
    groups: dict[str, dict[str, list[str]]] = {}
    while left:
        tally: dict[str, int] = {}
        for words in left.values():
            for gate in {w[i:j] for w in words for i in range(len(w)) for j in range(i + 4, len(w) + 1)} | set(words):
                tally[gate] = tally.get(gate, 0) + 1
        best = max(tally, key=lambda g: (tally[g], len(g), g))
        for name, p in [k for k, words in left.items() if any(best in w for w in words)]:
            groups.setdefault(best, {}).setdefault(name, []).append(p)
            del left[name, p]
    return groups


def signal_mask(text: str = "text", low: str = "low") -> Column:
    """Signals of a text column as a BIGINT bit set (plus the two driver_oom halves), additive with ``bit_or``."""
    bit = {name: 1 << i for i, name in enumerate(ALL_SIGNALS)}
    terms = []
    for gate, group in _gated().items():
        bits = [f"if({_guarded(text, low, alternatives)}, {bit[name]}L, 0L)" for name, alternatives in group.items()]
        terms.append(f"if(contains({low}, '{gate}'), {' | '.join(bits)}, 0L)")
    hint = _guarded(text, low, DRIVER_HINTS)
    both = bit["driver_oom"] | 1 << OOM_BIT | 1 << HINT_BIT
    terms.append(
        f"if({oom_condition(low)}, if({hint}, {both}L, {1 << OOM_BIT}L), if({hint}, {1 << HINT_BIT}L, 0L))"
    )
    stack = signal_condition("stacktrace_present", text, low)
    terms.append(f"if({stack}, {bit['stacktrace_present']}L, 0L)")
    return F.expr(" | ".join(f"({t})" for t in terms))


def mask_signals(mask: str = "mask") -> Column:
    """Bit set back to the sorted array of names."""
    both = (1 << OOM_BIT) | (1 << HINT_BIT)
    terms = []
    for i, name in enumerate(ALL_SIGNALS):
        on = f"({mask} & {1 << i}L) <> 0"
        if name == "driver_oom":
            on = f"({on} OR ({mask} & {both}L) = {both}L)"
        terms.append(f"if({on}, '{name}', NULL)")
    return _unless_empty(mask, f"array_compact(array({', '.join(terms)}))", "array<string>")


def _unless_empty(mask: str, sql: str, kind: str) -> Column:
    """``sql``, or an empty array for a mask without any bit: most texts show nothing, and each term costs time."""
    return F.expr(f"CASE WHEN {mask} = 0L THEN CAST(array() AS {kind}) ELSE {sql} END")


def first_lines(lines: str, mask: str) -> Column:
    """For each signal in ``mask``: (signal, at), the position of the first of ``lines`` that shows it, 0 for none."""
    terms = []
    for i, name in enumerate(ALL_SIGNALS):
        hits = f"transform({lines}, x -> {signal_condition(name, 'x.line', 'x.low')})"
        found = f"named_struct('signal', '{name}', 'at', CAST(array_position({hits}, true) AS INT))"
        terms.append(f"if(({mask} & {1 << i}L) <> 0, {found}, NULL)")
    return _unless_empty(mask, f"array_compact(array({', '.join(terms)}))", "array<struct<signal: string, at: int>>")
