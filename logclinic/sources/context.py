"""Investigation context given as JSON texts, one mapping per source, to context tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from logclinic.operators.fence import fenced
from logclinic.operators.investigate import Context

_NUMBER = "'^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)'"


class ParsedContext(NamedTuple):
    context: Context
    errors: DataFrame  # (source, reason)


def _v(path: str, of: str = "doc") -> str:
    return f"try_variant_get({of}, '$.{path}', 'variant')"


def _s(path: str, of: str) -> str:
    return f"try_variant_get({of}, '$.{path}', 'string')"


def _kind(v: str) -> str:
    return f"coalesce(schema_of_variant({v}), 'VOID')"


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in fields.items()) + ")"


def context_rows(texts: DataFrame) -> DataFrame:
    """(source, text) to (source, reason, runs, columns, metrics, plans, logs): every table as an array, in one pass.

    A context is one row, so nothing leaves it; the arrays of a rejected one are null.  ``runs`` and ``logs`` are accepted for ``previous_runs`` and
    ``log_lines``.  A bare text is a run id, a bare number a metric value; keys name tables and metrics that do not name themselves.
    A mapping that breaks these forms is rejected as a whole.
    """
    first = lambda a, b: f"coalesce({_v(a)}, {_v(b)})"
    given = {"runs": first("previous_runs", "runs"), "logs": first("log_lines", "logs"), "schemas": _v("schemas"), "metrics": _v("metrics"), "plan": _v("query_plan")}
    doc = fenced(
        texts.selectExpr("source", "text", "try_parse_json(text) AS doc").selectExpr(
            "source",
            "text",
            "doc",
            f"{_v('current_run')} AS current_run",
            *[f"{v} AS given_{n}" for n, v in given.items()],
            f"try_variant_get({given['runs']}, '$', 'array<variant>') AS previous",
            f"try_variant_get({given['logs']}, '$', 'array<variant>') AS log_items",
            f"try_variant_get({given['logs']}, '$', 'array<string>') AS logs",
            f"try_variant_get({given['schemas']}, '$', 'map<string,variant>') AS schemas",
            f"try_variant_get({given['metrics']}, '$', 'map<string,variant>') AS metrics",
            # key order only survives in the text itself
            "json_object_keys(get_json_object(text, '$.schemas')) AS tables",
            "json_object_keys(get_json_object(text, '$.metrics')) AS measured",
        )
    )
    is_map = lambda v: f"startswith({_kind(v)}, 'OBJECT')"
    absent_or = lambda v, test: f"({_kind(v)} = 'VOID' OR {test})"
    is_list = lambda v: f"startswith({_kind(v)}, 'ARRAY')"
    texts_in = lambda values: f"forall(coalesce({values}, array()), t -> {_kind('t')} = 'STRING')"
    text_fields = lambda v, *names: " AND ".join(absent_or(_v(n, v), f"{_kind(_v(n, v))} = 'STRING'") for n in names)
    is_run = lambda v: f"({_kind(v)} = 'STRING' OR ({is_map(v)} AND {text_fields(v, 'run_id', 'status', 'job', 'stage', 'error')}))"

    def text_list(v: str) -> str:
        values = f"try_variant_get({v}, '$', 'array<variant>')"
        return absent_or(v, f"({is_list(v)} AND {texts_in(values)})")

    def text_map(v: str) -> str:
        values = f"map_values(try_variant_get({v}, '$', 'map<string,variant>'))"
        return absent_or(v, f"({is_map(v)} AND {texts_in(values)})")

    is_schema = lambda v: f"({is_map(v)} AND {text_fields(v, 'table')} AND {text_list(_v('columns', v))} AND {text_map(_v('data_types', v))})"
    is_metric = lambda v: (
        f"({_kind(v)} RLIKE {_NUMBER} OR ({is_map(v)} AND {text_fields(v, 'name', 'unit', 'window')} "
        f"AND {_kind(_v('value', v))} RLIKE {_NUMBER} AND {text_map(_v('labels', v))}))"
    )
    reason = (
        f"CASE WHEN NOT {is_map('doc')} THEN 'not_a_mapping' "
        f"WHEN NOT (is_variant_null(coalesce(current_run, parse_json('null'))) OR {is_run('current_run')}) THEN 'current_run' "
        f"WHEN NOT {absent_or('given_runs', is_list('given_runs'))} OR exists(coalesce(previous, array()), r -> NOT {is_run('r')}) THEN 'previous_runs' "
        f"WHEN NOT {absent_or('given_logs', is_list('given_logs'))} OR NOT {texts_in('log_items')} THEN 'log_lines' "
        f"WHEN NOT {absent_or('given_schemas', is_map('given_schemas'))} OR exists(map_values(coalesce(schemas, map())), s -> NOT {is_schema('s')}) THEN 'schemas' "
        f"WHEN NOT {absent_or('given_metrics', is_map('given_metrics'))} OR exists(map_values(coalesce(metrics, map())), m -> NOT {is_metric('m')}) THEN 'metrics' "
        f"WHEN NOT {absent_or('given_plan', f"{_kind('given_plan')} = 'STRING'")} THEN 'query_plan' END"
    )
    checked = fenced(doc.selectExpr("*", f"{reason} AS reason"))

    def run(v: str, ordinal: str, current: str) -> str:
        named = f"if({_kind(v)} = 'STRING', try_variant_get({v}, '$', 'string'), coalesce({_s('run_id', v)}, ''))"
        return _struct(
            ordinal=f"CAST({ordinal} AS BIGINT)", is_current=current, run_id=named, status=f"coalesce({_s('status', v)}, 'unknown')",
            job=_s("job", v), stage=_s("stage", v), error=_s("error", v),
        )

    current = f"if(current_run IS NOT NULL AND NOT is_variant_null(current_run), array({run('current_run', '0', 'true')}), array())"
    previous = f"transform(coalesce(previous, array()), (r, i) -> {run('r', 'i + 1', 'false')})"
    # a lambda over an array of one element names a value, so that it is computed once
    column = _struct(
        tbl_ord="o", table_name=f"coalesce({_s('table', 's')}, k)", pos="if(c.name IS NULL AND c.none, NULL, i)", column_name="c.name",
        data_type=f"try_element_at(try_variant_get({_v('data_types', 's')}, '$', 'map<string,string>'), c.name)",
    )
    named = (
        f"transform(array(try_variant_get({_v('columns', 's')}, '$', 'array<string>')), n -> if(coalesce(size(n), 0) <= 0, "
        "array(named_struct('none', true, 'name', CAST(NULL AS STRING))), transform(n, x -> named_struct('none', false, 'name', x))))[0]"
    )
    columns = f"flatten(transform(coalesce(tables, array()), (k, o) -> flatten(transform(array(try_element_at(schemas, k)), s -> transform({named}, (c, i) -> {column})))))"
    number = f"if({is_map('m')}, try_variant_get(m, '$.value', 'double'), try_variant_get(m, '$', 'double'))"
    metric = _struct(
        ord="CAST(o AS BIGINT)", name=f"coalesce({_s('name', 'm')}, k)", value=number, unit=_s("unit", "m"),
        labels=f"coalesce(try_variant_get({_v('labels', 'm')}, '$', 'map<string,string>'), CAST(map() AS MAP<STRING, STRING>))", window=_s("window", "m"),
    )
    metrics = f"flatten(transform(coalesce(measured, array()), (k, o) -> transform(array(try_element_at(metrics, k)), m -> {metric})))"
    plans = f"filter(array({_struct(plan=_s('query_plan', 'doc'))}), p -> p.plan <> '')"
    logs = f"transform(coalesce(logs, array()), (x, i) -> {_struct(n='CAST(i + 1 AS BIGINT)', line='x')})"
    found = {"runs": f"concat({current}, {previous})", "columns": columns, "metrics": metrics, "plans": plans, "logs": logs}
    return fenced(checked.selectExpr("source", "reason", *[f"if(reason IS NULL, {sql}, NULL) AS {name}" for name, sql in found.items()]))


def parse_context(texts: DataFrame) -> ParsedContext:
    """``context_rows`` as context tables; each of them reads the texts anew, so one that needs all takes the rows."""
    rows = context_rows(texts)
    table = lambda name: rows.selectExpr("source", f"inline({name})")
    errors = rows.where("reason IS NOT NULL").select("source", "reason")
    return ParsedContext(Context(table("runs"), table("columns"), table("metrics"), table("plans"), table("logs")), errors)
