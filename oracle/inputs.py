"""SQL for the queries over raw inputs."""

from __future__ import annotations

from logclinic.functions.text import STACK_LINE_STARTS
from oracle.base import cte, diagnosis_chain, lit, pylines, statement, stripped

cte("files", "SELECT source, text, strlen(text) AS size, CASE regexp_extract(lower(source), '[^/](\\.[^./]+)$', 1) WHEN '.json' THEN 'json' WHEN '.jsonl' THEN 'jsonl' WHEN '.ndjson' THEN 'jsonl' ELSE 'text' END AS format FROM (SELECT source, text FROM inputs UNION ALL SELECT 'd' || doc_id || '.txt', text FROM documents)")
cte("tlines", f"SELECT source, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source, {pylines('text')} AS l FROM files WHERE format = 'text' AND {stripped('text')} <> '')")
_FRAME = " OR ".join(f"starts_with(line, {lit(m)})" for m in STACK_LINE_STARTS)
cte("tevent", f"SELECT f.source, f.text, (SELECT arg_min({stripped('line')}, i) FROM tlines t WHERE t.source = f.source AND {stripped('line')} <> '') AS error_message, (SELECT string_agg(line, chr(10) ORDER BY i) FROM tlines t WHERE t.source = f.source AND ({_FRAME})) AS stacktrace FROM files f WHERE format = 'text' AND {stripped('text')} <> ''")
# JSON items
cte("jdoc", "SELECT source, CASE WHEN json_valid(text) THEN text::JSON END AS doc FROM files WHERE format = 'json'")
cte("jitem", "SELECT source, i AS seq, v, TRUE AS in_array FROM (SELECT source, unnest(json_extract(doc, '$[*]')) AS v, unnest(range(1, json_array_length(doc)::BIGINT + 1)) AS i FROM jdoc WHERE json_type(doc) = 'ARRAY') UNION ALL SELECT source, 1, doc, FALSE FROM jdoc WHERE doc IS NULL OR json_type(doc) <> 'ARRAY'")
cte("jlines", f"SELECT source, i AS seq, {stripped('line')} AS line FROM (SELECT source, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source, {pylines('text')} AS l FROM files WHERE format = 'jsonl')) WHERE {stripped('line')} <> ''")
cte("items", """SELECT source, seq, v, CASE WHEN v IS NULL THEN 'invalid_json' WHEN json_type(v) <> 'OBJECT' THEN CASE WHEN in_array THEN 'item_not_object' ELSE 'not_object_or_array' END END AS reason FROM jitem
UNION ALL SELECT source, seq, v, CASE WHEN v IS NULL THEN 'invalid_json' WHEN json_type(v) <> 'OBJECT' THEN 'not_object' END FROM (SELECT source, seq, CASE WHEN json_valid(line) THEN line::JSON END AS v FROM jlines)""")


def alias(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(json_extract_string(v, '$.{n}'), '')" for n in names) + ")"


_TYPE = alias("error_type", "errorType", "exception_type", "exceptionType", "error_class")
_MESSAGE = alias("error_message", "errorMessage", "message", "msg")
_STACK = alias("stacktrace", "stackTrace", "stack_trace", "traceback")
_PLAIN = ", ".join(f"json_extract_string(v, '$.{n}') AS {n}" for n in ("id", "service", "job", "stage", "task"))
_BAD = " ".join(f"WHEN coalesce(json_type(json_extract(v, '$.{n}')), 'NULL') NOT IN ('VARCHAR', 'NULL') THEN 'invalid_field:{n}'" for n in ("id", "platform", "service", "job", "stage", "task"))
_SEV = "upper(json_extract_string(v, '$.severity'))"
_ATTRIBUTES = "coalesce(json_extract(v, '$.event_attributes'), json_extract(v, '$.eventAttributes'), '{}'::JSON)"
_SHOWN = f"array_to_string(list_transform(list_sort(json_keys({_ATTRIBUTES})), lambda k: k || '=' || json_extract_string({_ATTRIBUTES}, '$.' || k)), ',')"
cte("jchecked", f"SELECT source, seq, coalesce(reason, CASE {_BAD} WHEN {_SEV} NOT IN ('TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL') THEN 'invalid_field:severity' END) AS reason, {_PLAIN}, coalesce(json_extract_string(v, '$.platform'), 'unknown') AS platform, coalesce({_SEV}, 'ERROR') AS severity, {_TYPE} AS error_type, {_MESSAGE} AS error_message, {_STACK} AS stacktrace, coalesce(len(json_keys(coalesce(json_extract(v, '$.event_attributes'), json_extract(v, '$.eventAttributes'), '{{}}'::JSON))), 0)::BIGINT AS n_attributes, {_SHOWN} AS attributes FROM items")
cte("jerror", "SELECT source, min(seq) AS seq, arg_min(reason, seq) AS reason FROM jchecked WHERE reason IS NOT NULL GROUP BY source")
cte("jevent", "SELECT * EXCLUDE (reason) FROM jchecked WHERE source NOT IN (SELECT source FROM jerror)")
cte("fevents", "SELECT source, seq, platform, service, job, stage, task, error_type, error_message, stacktrace, NULL AS payload_text, CASE WHEN n_attributes > 0 THEN 'x' END AS attributes FROM jevent UNION ALL SELECT source, 1, 'unknown', NULL, NULL, NULL, NULL, NULL, error_message, stacktrace, text, NULL FROM tevent")
diagnosis_chain("f", "fevents")
cte("outcome", """SELECT x.source, CASE WHEN e.source IS NOT NULL THEN 'input_error' ELSE coalesce(r.status, 'insufficient_evidence') END AS status, CASE WHEN e.source IS NULL THEN coalesce(r.platform, 'unknown') END AS platform, CASE WHEN e.source IS NULL THEN coalesce(r.event_count, 0) END AS event_count, r.top_rule, r.top_score, r.top_band, r.n_matches, CASE WHEN e.source IS NOT NULL THEN e.reason || ' at ' || e.seq ELSE coalesce(r.message, 'No diagnosis matched the available evidence. There is insufficient evidence to support a conclusion.') END AS message FROM files x LEFT JOIN jerror e USING (source) LEFT JOIN f_report r USING (source)""")

_EVENT = "source, seq, id, platform, service, job, stage, task, severity, error_type, error_message, stacktrace, n_attributes, coalesce(attributes, '') AS attributes"
SQL = {
    "detect_format": "SELECT source, format FROM files",
    "size_guard": "SELECT source, 'too_large' AS reason FROM files WHERE size > 4096",
    "decode_tolerant": "SELECT 'd' || doc_id AS source, chr(65533) || text || chr(65533) AS text FROM documents",
    "scan_text": "SELECT source, 1 AS seq, 'unknown' AS platform, 'ERROR' AS severity, text AS payload_text FROM tevent",
    "text_event": "SELECT source, error_message, stacktrace FROM tevent",
    "scan_json": f"SELECT {_EVENT} FROM jevent WHERE source IN (SELECT source FROM jdoc)",
    "scan_jsonl": f"SELECT {_EVENT} FROM jevent WHERE source IN (SELECT source FROM jlines)",
    "event_validate": "SELECT source, seq, reason FROM jerror",
    "alias_coalesce": "SELECT source, seq, error_type, error_message, stacktrace FROM jevent",
    "input_status": "SELECT source, status, platform, event_count, top_rule, top_score, message FROM outcome",
    "scan_batch": "SELECT o.source, f.size + 1 AS size, f.format, o.status, o.platform, o.event_count, o.top_rule, o.top_score, o.message, 'diagnosed ' || (count(*) FILTER (WHERE o.status = 'diagnosed') OVER ()) || ' of ' || (count(*) OVER ()) || ' input(s)' AS summary FROM outcome o JOIN files f USING (source) WHERE o.source IN (SELECT source FROM inputs)",
    "batch_verdict": "SELECT *, FALSE AS fail_never, diagnosed > 0 AS fail_diagnosed, errors > 0 AS fail_error, 'diagnosed ' || diagnosed || ' of ' || total || ' input(s)' AS summary FROM (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'diagnosed') AS diagnosed, count(*) FILTER (WHERE status = 'input_error') AS errors FROM outcome)",
}
STATEMENTS = {name: statement(sql) for name, sql in SQL.items()}
