"""Named common table expressions and their assembly into one statement."""

from __future__ import annotations

import re

from logclinic.functions import exceptions, platforms, redaction, signals, text
from logclinic.rules.catalog import RULES
from workload.tables import template_rows
from workload.templates import FAILURES, FIELDS


def lit(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return str(value)
    pieces = re.split("([\x00-\x1f\x7f-\U0010ffff])", str(value))
    quoted = [f"chr({ord(p)})" if len(p) == 1 and (ord(p) < 32 or ord(p) > 126) else "'" + p.replace("'", "''") + "'" for p in pieces if p]
    return "(" + " || ".join(quoted) + ")" if quoted else "''"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ",\n".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def regex(alternatives: list[str]) -> str:
    return lit("(?i)" + signals.pattern(alternatives, r"\s"))


HINTS = "(?:" + signals.pattern(signals.DRIVER_HINTS, r"\s") + ")"
SIGNAL_REGEX = {name: regex(alts) for name, alts in signals.SIGNALS.items()}
SIGNAL_REGEX["driver_oom"] = lit(rf"(?i)OutOfMemoryError[\s\S]*?{HINTS}|{HINTS}[\s\S]*?OutOfMemoryError")
SIGNAL_REGEX["stacktrace_present"] = lit("(?m)" + signals.STACK_PATTERN)
BLANKS = lit(text.BLANKS)
LINE_BREAK = lit(r"\r\n|[\n\x0B\f\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]")


def fill(column: str) -> str:
    return f"replace(replace({column}, '{{id}}', event_id::VARCHAR), '{{user}}', user_id::VARCHAR)"


def redact(column: str) -> str:
    out = column
    for _, ignore_case, pattern, replacement in redaction.RULES:
        out = f"regexp_replace({out}, {lit(('(?i)' if ignore_case else '') + pattern)}, {lit(replacement)}, 'g')"
    return out


def platform_of(column: str) -> str:
    whens = [
        f"WHEN {' OR '.join(f'contains(lower({column}), {lit(m)})' for m in markers)} THEN {lit(name)}"
        for name, markers in platforms.MARKERS.items()
    ]
    return "CASE " + " ".join(whens) + " ELSE 'unknown' END"


def stripped(column: str) -> str:
    return f"trim({column}, {BLANKS})"


def pylines(column: str) -> str:
    """Lines of a text as a list, without the empty one after a final break."""
    parts = f"regexp_split_to_array({column}, {LINE_BREAK})"
    return f"CASE WHEN {column} = '' THEN [] WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def band(column: str) -> str:
    return f"CASE WHEN {column} >= 70 THEN 'HIGH' WHEN {column} >= 40 THEN 'MEDIUM' ELSE 'LOW' END"


def exception_list(column: str) -> str:
    return f"regexp_extract_all({column}, {lit(exceptions.NAME_PATTERN)}, 1)"


CTES: dict[str, str] = {}


#: Expressions read many times: pooled texts and what is searched in them.
MATERIALIZED = re.compile("_(pool|sig|lines|hits|names)$")


def cte(name: str, body: str) -> None:
    CTES[name] = f"{name} AS {'MATERIALIZED ' if MATERIALIZED.search(name) else ''}({body})"


def statement(select: str, extra: dict[str, str] | None = None) -> str:
    """``select`` preceded by exactly the expressions it needs, in definition order."""
    known = {**CTES, **(extra or {})}
    needed: set[str] = set()

    def visit(sql: str, skip: str | None = None) -> None:
        for name in known:
            if name != skip and name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(known[name], name)

    visit(select)
    parts = [known[name] for name in known if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


# --- constants ------------------------------------------------------------------------------------------------
CTES["tmpl"] = values(
    "tmpl", "tkey, tname, kind, ids, band, status, ext, content, attributes, " + ", ".join(FIELDS), template_rows()
)
CTES["rules"] = values(
    "rules", "rule_id, rname, category, severity, severity_rank",
    [(r.rule_id, r.name, r.category, r.severity, ["critical", "high", "medium", "low"].index(r.severity)) for r in RULES],
)
CTES["rule_pos"] = values("rule_pos", "rule_id, signal, ordinal", [(r.rule_id, s, i) for r in RULES for i, s in enumerate(r.positive)])
CTES["rule_neg"] = values("rule_neg", "rule_id, signal, ordinal", [(r.rule_id, s, i) for r in RULES for i, s in enumerate(r.negative)])
CTES["rule_exc"] = values("rule_exc", "rule_id, exc", [(r.rule_id, e) for r in RULES for e in r.exceptions])
CTES["rule_plat"] = values("rule_plat", "rule_id, platform, ordinal", [(r.rule_id, p, i) for r in RULES for i, p in enumerate(r.platforms)])
CTES["rule_hyp"] = values("rule_hyp", "rule_id, hypothesis, ordinal", [(r.rule_id, h, i) for r in RULES for i, h in enumerate(r.hypotheses)])
CTES["sigdef"] = values("sigdef", "signal, exact", [(s, s not in signals.HEURISTIC) for s in signals.ALL_SIGNALS])

# --- derived events -------------------------------------------------------------------------------------------
_KEY = f"CASE WHEN e.event_type = 'error' THEN 'error-' || (e.event_id % {len(FAILURES)}) ELSE e.event_type END"
cte("base", f"SELECT e.event_id, e.user_id, e.ts, t.* FROM events e JOIN tmpl t ON t.tkey = {_KEY}")
_FILLED = ", ".join(f"{fill(f)} AS {f}" for f in FIELDS if f != "severity")
cte("fe", f"SELECT 'u' || user_id || '-w' || week(ts) AS source, event_id AS seq, upper(severity) AS severity, attributes, {_FILLED} FROM base")
cte("one", f"SELECT 'e' || event_id AS source, event_id AS seq, upper(severity) AS severity, attributes, {_FILLED} FROM base")
cte("inputs", f"SELECT 'in/' || tname || '-' || event_id || '.' || ext AS source, {fill('content')} AS text, tname, kind, ids, band, status, event_id FROM base")


def diagnosis_chain(prefix: str, events: str) -> None:
    """The whole diagnosis as expressions named ``prefix_*`` over an event expression."""
    p = prefix
    cte(f"{p}_parts", f"SELECT source, seq, 1 AS p, error_message AS t FROM {events} WHERE error_message <> '' UNION ALL SELECT source, seq, 2, stacktrace FROM {events} WHERE stacktrace <> '' UNION ALL SELECT source, seq, 3, payload_text FROM {events} WHERE payload_text <> ''")
    cte(f"{p}_text", f"SELECT source, string_agg(t, chr(10) ORDER BY seq, p) AS text, string_agg(t, chr(10) ORDER BY seq) FILTER (WHERE p = 3) AS raw FROM {p}_parts GROUP BY source")
    meta = "coalesce(job, '') <> '' OR coalesce(stage, '') <> '' OR coalesce(service, '') <> '' OR coalesce(task, '') <> '' OR attributes IS NOT NULL"
    cte(f"{p}_src", f"SELECT source, count(*) AS n_events, bool_or({meta}) AS has_metadata, bool_or(coalesce(stacktrace, '') <> '') AS has_stack, arg_min(platform, seq) FILTER (WHERE platform <> 'unknown' AND platform <> '') AS event_platform FROM {events} GROUP BY source")
    cte(f"{p}_pool", f"SELECT s.*, coalesce(t.text, '') AS text, coalesce(t.raw, t.text, '') AS cited FROM {p}_src s LEFT JOIN {p}_text t USING (source)")
    cte(f"{p}_plat", f"SELECT source, coalesce(nullif(tp, 'unknown'), event_platform, 'unknown') AS platform, tp AS text_platform FROM (SELECT *, {platform_of('text')} AS tp FROM {p}_pool)")
    sigs = " UNION ALL ".join(f"SELECT source, {lit(n)} AS signal FROM {p}_pool WHERE regexp_matches(text, {r})" for n, r in SIGNAL_REGEX.items())
    cte(f"{p}_sig", sigs)
    cte(f"{p}_stack", f"SELECT source, has_stack OR source IN (SELECT source FROM {p}_sig WHERE signal = 'stacktrace_present') AS stack, has_metadata AS metadata FROM {p}_src")
    cte(f"{p}_names", f"SELECT source, unnest(l) AS full_name, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source, {exception_list('text')} AS l FROM {p}_pool)")
    cte(f"{p}_exc", f"SELECT DISTINCT source, unnest([full_name, regexp_extract(full_name, '[^.]*$')]) AS exc FROM {p}_names")
    cte(f"{p}_first", f"SELECT source, arg_min(full_name, i) AS first_exception FROM {p}_names GROUP BY source")
    cte(f"{p}_obs", f"SELECT source, exc FROM {p}_exc UNION SELECT source, unnest([error_type, regexp_extract(error_type, '[^.]*$')]) FROM {events} WHERE error_type <> ''")
    cte(f"{p}_mpos", f"SELECT g.source, r.rule_id, r.signal FROM {p}_sig g JOIN rule_pos r USING (signal)")
    cte(f"{p}_mneg", f"SELECT DISTINCT g.source, r.rule_id FROM {p}_sig g JOIN rule_neg r USING (signal)")
    cte(f"{p}_mexc", f"SELECT DISTINCT o.source, r.rule_id, r.exc FROM {p}_obs o JOIN rule_exc r ON o.exc = r.exc OR ends_with(o.exc, '.' || r.exc)")
    cte(f"{p}_cand", f"SELECT DISTINCT source, rule_id FROM {p}_mpos UNION SELECT source, rule_id FROM {p}_mexc WHERE rule_id NOT IN (SELECT rule_id FROM rule_pos)")
    cte(f"{p}_match", f"SELECT c.source, c.rule_id, q.platform, q.platform <> 'unknown' AS platform_match FROM {p}_cand c JOIN {p}_plat q USING (source) WHERE (q.platform = 'unknown' OR EXISTS (SELECT 1 FROM rule_plat x WHERE x.rule_id = c.rule_id AND x.platform = q.platform)) AND NOT EXISTS (SELECT 1 FROM {p}_mneg n WHERE n.source = c.source AND n.rule_id = c.rule_id)")
    # cited lines
    cte(f"{p}_alllines", f"SELECT source, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS no FROM (SELECT source, regexp_split_to_array(cited, {LINE_BREAK}) AS l FROM {p}_pool)")
    cte(f"{p}_lines", f"SELECT source, no, {stripped('line')} AS line, row_number() OVER (PARTITION BY source ORDER BY no) AS rn FROM {p}_alllines WHERE {stripped('line')} <> ''")
    hits = " UNION ALL ".join(f"SELECT l.source, l.no, g.signal FROM {p}_lines l JOIN {p}_sig g ON g.source = l.source AND g.signal = {lit(n)} WHERE regexp_matches(l.line, {r})" for n, r in SIGNAL_REGEX.items())
    cte(f"{p}_hits", hits)
    cte(f"{p}_sline", f"SELECT m.source, m.rule_id, min(h.no) AS no FROM {p}_match m JOIN {p}_mpos s ON s.source = m.source AND s.rule_id = m.rule_id JOIN {p}_hits h ON h.source = m.source AND h.signal = s.signal GROUP BY m.source, m.rule_id")
    cte(f"{p}_xline", f"SELECT m.source, m.rule_id, coalesce(min(l.no) FILTER (WHERE NOT starts_with(l.line, 'at ')), min(l.no)) AS no FROM {p}_match m JOIN {p}_mexc x ON x.source = m.source AND x.rule_id = m.rule_id JOIN {p}_lines l ON l.source = m.source AND contains(l.line, x.exc) GROUP BY m.source, m.rule_id")
    shown = lambda a: f"'line ' || {a}.no || ': ' || {redact(a + '.line')}"
    block = f"{shown('c')} || coalesce(' | ' || {shown('b')}, '') || coalesce(' | ' || {shown('n')}, '')"
    joins = f"JOIN {p}_lines c ON c.source = k.source AND c.no = k.no LEFT JOIN {p}_lines b ON b.source = c.source AND b.rn = c.rn - 1 LEFT JOIN {p}_lines n ON n.source = c.source AND n.rn = c.rn + 1"
    clamp = "CASE WHEN length(x) > 200 THEN substr(x, 1, 197) || '...' ELSE x END"
    for kind in ("sline", "xline"):
        cte(f"{p}_{kind}_text", f"SELECT source, rule_id, {clamp} AS excerpt FROM (SELECT k.source, k.rule_id, {block} AS x FROM {p}_{kind} k {joins})")
    cte(f"{p}_excerpt", f"SELECT m.source, m.rule_id, s.excerpt AS signal_excerpt, x.excerpt AS exception_excerpt FROM {p}_match m LEFT JOIN {p}_sline_text s ON s.source = m.source AND s.rule_id = m.rule_id LEFT JOIN {p}_xline_text x ON x.source = m.source AND x.rule_id = m.rule_id")
    # evidence
    cte(f"{p}_evraw", f"""SELECT m.source, m.rule_id, CASE WHEN d.exact THEN 1 ELSE 2 END AS class, s.signal AS k, CASE WHEN d.exact THEN 'error_signature' ELSE 'correlated_signal' END AS type, CASE WHEN d.exact THEN 40 ELSE 15 END AS weight, CASE WHEN d.exact THEN 'Exact error signature matched: ' ELSE 'Supporting signal observed: ' END || s.signal AS description, 'signal:' || s.signal AS origin, FALSE AS prefers_exception FROM {p}_match m JOIN {p}_mpos s ON s.source = m.source AND s.rule_id = m.rule_id JOIN sigdef d ON d.signal = s.signal
UNION ALL SELECT m.source, m.rule_id, 3, '', 'stacktrace_evidence', 20, 'Declared exception observed in ' || CASE WHEN k.stack THEN 'stack trace' ELSE 'failure text' END || ': ' || string_agg(x.exc, ', ' ORDER BY x.exc), 'exception:' || string_agg(x.exc, ',' ORDER BY x.exc), NULL FROM {p}_match m JOIN {p}_mexc x ON x.source = m.source AND x.rule_id = m.rule_id JOIN {p}_stack k ON k.source = m.source GROUP BY m.source, m.rule_id, k.stack
UNION ALL SELECT m.source, m.rule_id, 4, '', 'platform_match', 20, 'Platform detected: ' || m.platform || ' (diagnosis supports: ' || (SELECT string_agg(x.platform, ', ' ORDER BY x.ordinal) FROM rule_plat x WHERE x.rule_id = m.rule_id) || ')', 'platform:detect', TRUE FROM {p}_match m WHERE m.platform_match
UNION ALL SELECT m.source, m.rule_id, 5, '', 'supporting_metadata', 5, 'Runtime metadata present (job/stage/service/attributes)', 'metadata:event', TRUE FROM {p}_match m JOIN {p}_stack k ON k.source = m.source WHERE k.metadata""")
    cte(f"{p}_ev", f"SELECT v.source, v.rule_id, row_number() OVER (PARTITION BY v.source, v.rule_id ORDER BY class, k) AS ev_no, type, weight, description, origin, CASE WHEN class <= 2 THEN signal_excerpt WHEN class = 3 THEN exception_excerpt ELSE coalesce(exception_excerpt, signal_excerpt) END AS excerpt FROM {p}_evraw v JOIN {p}_excerpt e ON e.source = v.source AND e.rule_id = v.rule_id")
    cte(f"{p}_score", f"SELECT source, rule_id, least(100, sum(weight))::BIGINT AS score, count(*) AS n_evidence FROM {p}_evraw GROUP BY source, rule_id")
    cte(f"{p}_rank", f"SELECT s.source, s.rule_id, s.score, s.n_evidence, {band('s.score')} AS band, r.severity_rank, r.rname, r.category, row_number() OVER (PARTITION BY s.source ORDER BY s.score DESC, r.severity_rank, s.rule_id) AS rank, count(*) OVER (PARTITION BY s.source) AS n_matches FROM {p}_score s JOIN rules r USING (rule_id)")
    cte(f"{p}_types", f"SELECT source, string_agg(exc, ',' ORDER BY exc) AS error_types FROM (SELECT source, exc FROM {p}_exc UNION SELECT source, error_type FROM {events} WHERE error_type <> '') GROUP BY source")
    cte(f"{p}_report", f"""SELECT q.source, q.platform, s.n_events AS event_count, coalesce(t.error_types, '') AS error_types, coalesce(r.n_matches, 0) AS n_matches, r.rule_id AS top_rule, r.score AS top_score, r.band AS top_band, CASE WHEN r.score >= 40 THEN 'diagnosed' ELSE 'insufficient_evidence' END AS status,
CASE WHEN r.rule_id IS NULL THEN 'No diagnosis matched the available evidence. There is insufficient evidence to support a conclusion.' WHEN r.score >= 40 THEN r.rule_id || ' selected with ' || r.band || ' confidence (' || r.score || '/100) based on ' || r.n_evidence || ' evidence item(s).' || CASE WHEN r.n_matches > 1 THEN ' ' || (r.n_matches - 1) || ' competing diagnosis(es) considered.' ELSE '' END ELSE 'Best candidate ' || r.rule_id || ' reached only ' || r.band || ' confidence (' || r.score || '/100). Insufficient evidence for a conclusion.' END AS message
FROM {p}_plat q JOIN {p}_src s USING (source) LEFT JOIN {p}_types t USING (source) LEFT JOIN {p}_rank r ON r.source = q.source AND r.rank = 1""")


diagnosis_chain("w", "fe")
diagnosis_chain("o", "one")
