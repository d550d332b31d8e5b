"""SQL for the queries over structured context."""

from __future__ import annotations

from oracle.base import LINE_BREAK, SIGNAL_REGEX, cte, lit, redact, statement, stripped

cte("vruns", """SELECT 'c' || o_custkey AS source, (100000 - date_diff('day', DATE '1970-01-01', o_orderdate::DATE)) * 10000000000000 + o_orderkey AS ordinal, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n, 'run-' || o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'done' END AS status, lower(o_orderpriority) AS job, substr(o_orderpriority, 1, 1) AS stage, CASE WHEN o_orderstatus = 'F' THEN 'run stopped: ' || CASE o_orderpriority WHEN '1-URGENT' THEN 'authentication failed token=t' WHEN '2-HIGH' THEN 'Missing an output location for shuffle ' WHEN '3-MEDIUM' THEN 'ConcurrentAppendException in run ' ELSE 'no reason given, password: p' END || o_orderkey END AS error FROM orders""")
cte("vschemas", "SELECT l_orderkey, 'k' || l_orderkey AS source, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS tbl_ord, 'lines_' || lower(l_linestatus) AS table_name, ascii(l_returnflag) * 2 + l_linenumber % 2 AS pos, 'c_' || l_returnflag || (l_linenumber % 2) AS column_name, min('t' || (l_suppkey % 3)) AS data_type FROM lineitem GROUP BY ALL")
cte("vmetrics", "SELECT 'u' || user_id || '-w' || week(ts) AS source, event_type AS name, count(*)::DOUBLE AS value, (max((props->>'$.k')::BIGINT) % 5 + 1)::VARCHAR AS stage, (min((props->>'$.k')::BIGINT) % 3)::VARCHAR AS executor FROM events GROUP BY ALL")
cte("vmshown", "SELECT *, ascii(name) AS ord, name || '=' || value::VARCHAR || ' events' || CASE WHEN name = 'error' THEN ' [1w]' ELSE '' END AS shown FROM vmetrics")
cte("vplans", "SELECT p_partkey, 'p' || p_partkey AS source, '== Physical Plan ==' || chr(10) || 'Scan ' || p_name || ' [' || p_type || ']' || chr(10) || CASE p_brand WHEN 'Brand#1' THEN 'authentication failed password=x' WHEN 'Brand#2' THEN 'Missing an output location for shuffle ' WHEN 'Brand#3' THEN 'skewed partition ' ELSE 'Exchange ' END || p_partkey AS plan FROM part")
cte("vlogs", "SELECT source, seq AS n, replace(error_message, chr(10), ' ') AS line FROM fe WHERE error_message IS NOT NULL")
cte("vdoclines", f"SELECT source, i AS n, line FROM (SELECT 'd' || doc_id AS source, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, {LINE_BREAK}) AS l FROM documents))")
# context of the derived failure sources
cte("vusers", "SELECT DISTINCT 'u' || user_id || '-w' || week(ts) AS source, user_id FROM events")
cte("cruns", "SELECT u.source, r.* EXCLUDE (source) FROM vusers u JOIN vruns r ON r.source = 'c' || u.user_id")
cte("cschemas", "SELECT u.source, s.* EXCLUDE (source) FROM vusers u JOIN vschemas s ON s.l_orderkey = u.user_id")
cte("cplans", "SELECT u.source, p.plan FROM vusers u JOIN vplans p ON p.p_partkey = u.user_id")
cte("ctop", "SELECT k.source, k.rule_id, r.category, split_part(r.category, '.', 1) AS family FROM w_rank k JOIN rules r USING (rule_id) WHERE rank = 1")
cte("cflags", """SELECT t.*, EXISTS (SELECT 1 FROM cplans p WHERE p.source = t.source) AS has_plan, (SELECT any_value(table_name) FROM cschemas s WHERE s.source = t.source AND tbl_ord = 0) AS t1, (SELECT any_value(table_name) FROM cschemas s WHERE s.source = t.source AND tbl_ord = 1) AS t2, EXISTS (SELECT 1 FROM vmetrics m WHERE m.source = t.source) AS has_metrics, (SELECT stage FROM cruns r WHERE r.source = t.source AND n = 1) AS stage, EXISTS (SELECT 1 FROM cruns r WHERE r.source = t.source AND n = 1) AS has_current, EXISTS (SELECT 1 FROM cruns r WHERE r.source = t.source AND n > 1) AS has_previous, EXISTS (SELECT 1 FROM vlogs l WHERE l.source = t.source) AS has_logs, EXISTS (SELECT 1 FROM rule_plat x WHERE x.rule_id = t.rule_id AND x.platform = 'spark') AS on_spark FROM ctop t""")
_RUNTIME = "family IN ('spark', 'performance', 'connectivity')"
_SHAPES = "family IN ('schema', 'delta', 'quality')"
_HISTORY = "family IN ('spark', 'delta', 'connectivity')"
_STEPS = [
    ("has_plan AND family IN ('spark', 'performance')", "inspect_query_plan", "NULL", "NULL"),
    (f"t1 IS NOT NULL AND {_SHAPES}", "get_schema", "t1", "NULL"),
    (f"t2 IS NOT NULL AND {_SHAPES}", "get_schema", "t2", "NULL"),
    (f"t2 IS NOT NULL AND {_SHAPES}", "compare_schema", "t1", "t2"),
    (f"has_metrics AND {_RUNTIME}", "get_metrics", "NULL", "NULL"),
    (f"has_metrics AND {_RUNTIME} AND on_spark", "get_executor_metrics", "NULL", "NULL"),
    (f"has_metrics AND {_RUNTIME} AND stage IS NOT NULL", "get_stage_metrics", "stage", "NULL"),
    (f"(has_current OR has_previous) AND {_HISTORY}", "get_pipeline_run", "NULL", "NULL"),
    (f"has_previous AND {_HISTORY}", "get_previous_runs", "NULL", "NULL"),
    (f"has_previous AND {_HISTORY}", "compare_runs", "NULL", "NULL"),
    *[(f"has_logs AND EXISTS (SELECT 1 FROM rule_pos p WHERE p.rule_id = f.rule_id AND p.ordinal = {i})", "search_logs", f"(SELECT replace(signal, '_', ' ') FROM rule_pos p WHERE p.rule_id = f.rule_id AND p.ordinal = {i})", "NULL") for i in (0, 1)],
    ("family IN ('spark', 'delta')", "search_knowledge_base", "category", "NULL"),
]
cte("cprobe", "SELECT source, rule_id, row_number() OVER (PARTITION BY source ORDER BY step) AS probe_no, tool, arg1, arg2 FROM (" + " UNION ALL ".join(f"SELECT source, rule_id, {i} AS step, '{tool}' AS tool, {a} AS arg1, {b} AS arg2 FROM cflags f WHERE {cond}" for i, (cond, tool, a, b) in enumerate(_STEPS)) + ")")
_STATE = "r.run_id || ' status=' || r.status || coalesce(' error=' || r.error, '')"
cte("cdiff", "SELECT source, coalesce((SELECT string_agg(column_name, ',' ORDER BY column_name) FROM {b} x WHERE x.source = s.source AND x.tbl_ord = 1 AND x.column_name NOT IN (SELECT column_name FROM {b} y WHERE y.source = s.source AND y.tbl_ord = 0)), '') AS added, coalesce((SELECT string_agg(column_name, ',' ORDER BY column_name) FROM {b} x WHERE x.source = s.source AND x.tbl_ord = 0 AND x.column_name NOT IN (SELECT column_name FROM {b} y WHERE y.source = s.source AND y.tbl_ord = 1)), '') AS removed FROM {b} s GROUP BY source HAVING count(DISTINCT tbl_ord) = 2".replace("{b}", "cschemas"))
cte("ccompare", "SELECT b.source, b.run_id AS base_run, o.run_id AS other_run, b.status AS base_status, o.status AS other_status, b.stage AS base_stage, o.stage AS other_stage FROM {r} b JOIN {r} o ON o.source = b.source AND b.n = 1 AND o.n = 2".replace("{r}", "cruns"))
cte("clines", f"""SELECT q.source, q.probe_no, q.tool, 1 AS seq, substr({redact('p.plan')}, 1, 2000) AS line FROM cprobe q JOIN cplans p USING (source) WHERE tool = 'inspect_query_plan'
UNION ALL SELECT q.source, q.probe_no, q.tool, s.pos, s.column_name FROM cprobe q JOIN cschemas s ON s.source = q.source AND s.table_name = q.arg1 WHERE tool = 'get_schema'
UNION ALL SELECT q.source, q.probe_no, q.tool, 1, d.added || ' ' || d.removed FROM cprobe q JOIN cdiff d USING (source) WHERE tool = 'compare_schema'
UNION ALL SELECT q.source, q.probe_no, q.tool, m.ord, m.shown FROM cprobe q JOIN vmshown m USING (source) WHERE tool IN ('get_metrics', 'get_executor_metrics') OR (tool = 'get_stage_metrics' AND m.stage = q.arg1)
UNION ALL SELECT q.source, q.probe_no, q.tool, 1, {_STATE} FROM cprobe q JOIN cruns r USING (source) WHERE tool = 'get_pipeline_run' AND r.n = 1
UNION ALL SELECT q.source, q.probe_no, q.tool, r.ordinal, {_STATE} FROM cprobe q JOIN cruns r USING (source) WHERE tool = 'get_previous_runs' AND r.n > 1
UNION ALL SELECT q.source, q.probe_no, q.tool, 1, c.base_run || c.other_run FROM cprobe q JOIN ccompare c USING (source) WHERE tool = 'compare_runs'
UNION ALL SELECT q.source, q.probe_no, q.tool, l.n, l.n || ': ' || l.line FROM cprobe q JOIN vlogs l USING (source) WHERE tool = 'search_logs' AND contains(lower(l.line), q.arg1)
UNION ALL SELECT q.source, q.probe_no, q.tool, 1, r.rule_id FROM cprobe q JOIN rules r ON contains(r.category, q.arg1) WHERE tool = 'search_knowledge_base'""")
cte("cresult", "SELECT q.source, q.rule_id, q.probe_no, q.tool, q.arg1, q.arg2, count(l.probe_no) AS n_lines, CASE WHEN count(l.probe_no) > 0 OR q.tool IN ('search_logs', 'search_knowledge_base') THEN 'success' ELSE 'unavailable' END AS status FROM cprobe q LEFT JOIN clines l ON l.source = q.source AND l.probe_no = q.probe_no GROUP BY q.source, q.rule_id, q.probe_no, q.tool, q.arg1, q.arg2")
cte("cdetail", f"SELECT source, probe_no, string_agg({redact('line')}, chr(10) ORDER BY seq) AS text FROM clines WHERE tool <> 'search_knowledge_base' GROUP BY source, probe_no")
cte("csignal", " UNION ALL ".join(f"SELECT source, probe_no, {lit(n)} AS signal FROM cdetail WHERE regexp_matches(text, {r})" for n, r in SIGNAL_REGEX.items()))
cte("cverified", "SELECT q.source, q.rule_id, q.probe_no, q.tool, (SELECT arg_min(n.signal, n.ordinal) FROM rule_neg n JOIN csignal s ON s.signal = n.signal WHERE n.rule_id = q.rule_id AND s.source = q.source AND s.probe_no = q.probe_no) AS contradiction, coalesce((SELECT string_agg(n.signal, ',' ORDER BY n.ordinal) FROM rule_pos n JOIN csignal s ON s.signal = n.signal WHERE n.rule_id = q.rule_id AND s.source = q.source AND s.probe_no = q.probe_no), '') AS supports FROM cresult q")
cte("cstop", "SELECT source, rule_id, max(probe_no) AS n_probes, min(probe_no) FILTER (WHERE contradiction IS NOT NULL AND probe_no <= 8) AS stop_no FROM cverified GROUP BY source, rule_id")
cte("crecord", """SELECT t.source, t.rule_id, CASE WHEN NOT (f.has_plan OR f.t1 IS NOT NULL OR f.has_metrics OR f.has_current OR f.has_previous OR f.has_logs) THEN 'insufficient_context' WHEN s.stop_no IS NULL AND s.n_probes > 8 THEN 'limit_reached' ELSE 'success' END AS status, coalesce(s.stop_no, least(s.n_probes, 8), 0) AS tool_calls, s.stop_no IS NOT NULL AS contradicted, v.contradiction, v.tool AS contradicted_by, s.n_probes FROM ctop t JOIN cflags f ON f.source = t.source LEFT JOIN cstop s ON s.source = t.source LEFT JOIN cverified v ON v.source = t.source AND v.probe_no = s.stop_no""")

# JSON contexts, answered from the columns they were written from
cte("xorder", "SELECT 'o' || o_orderkey AS source, o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr, CASE WHEN o_custkey % 20 IN (4, 5) OR (o_orderpriority = '4-NOT SPECIFIED') THEN 'previous_runs' WHEN o_custkey % 20 = 0 THEN 'log_lines' WHEN o_custkey % 20 IN (2, 3) THEN 'schemas' WHEN o_custkey % 20 = 1 OR o_orderpriority = '5-LOW' THEN 'metrics' WHEN o_custkey % 20 = 6 THEN 'query_plan' END AS reason FROM orders")
cte("xgood", "SELECT * FROM xorder WHERE reason IS NULL")
SQL = {
    "context_normalize": """SELECT source, 'error' AS kind, 0 AS ord, reason AS content FROM xorder WHERE reason IS NOT NULL
UNION ALL SELECT source, 'run', 0, 'true/r' || k || CASE st WHEN 'F' THEN '/failed/-/3' ELSE '/unknown/-/-' END FROM xgood WHERE st IN ('F', 'O')
UNION ALL SELECT source, 'run', o, c FROM xgood, (VALUES (1, 'false//done/j/-'), (2, 'false/b/unknown/-/-')) v(o, c)
UNION ALL SELECT source, 'schema', o, c FROM xgood, (VALUES (0, '0/t2/b/-'), (1, '0/t2/a/int'), (0, '1/x/c/-')) v(o, c)
UNION ALL SELECT source, 'metric', 0, 'rows/' || k::DOUBLE::VARCHAR || '/-/-' FROM xgood
UNION ALL SELECT source, 'metric', 1, 'bytes/2.5/mb/' || k FROM xgood
UNION ALL SELECT source, 'plan', 0, 'Scan ' || k FROM xgood
UNION ALL SELECT source, 'log', 1, 'l' || k FROM xgood
UNION ALL SELECT source, 'log', 2, '' FROM xgood""",
    "get_logs": f"SELECT source, n, {redact('line')} AS line FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n) AS rn FROM (SELECT source, n, line FROM vlogs UNION ALL SELECT source, n, line FROM vdoclines) WHERE {stripped('line')} <> '') WHERE rn <= 5",
    "search_logs": f"SELECT source, n, {redact('line')} AS line, matches, first_no FROM (SELECT source, n, line, row_number() OVER (PARTITION BY source ORDER BY n) AS rn, count(*) OVER (PARTITION BY source) AS matches, min(n) OVER (PARTITION BY source) AS first_no FROM vlogs WHERE contains(lower(line), 'spark')) WHERE rn <= 3",
    "get_run": f"SELECT source, run_id, status, job, stage, {redact('error')} AS error, 'current' AS asked FROM vruns WHERE n = 1 UNION ALL SELECT r.source, r.run_id, r.status, r.job, r.stage, {redact('r.error')}, 'named' FROM vruns r JOIN (SELECT 'c' || o_custkey AS source, 'run-' || min(o_orderkey) AS run_id FROM orders GROUP BY o_custkey) w ON w.source = r.source AND w.run_id = r.run_id",
    "run_history": f"SELECT source, ordinal, run_id, status, job, stage, {redact('error')} AS error FROM vruns WHERE n BETWEEN 2 AND 4",
    "compare_runs": "SELECT b.source, b.run_id AS base_run, o.run_id AS other_run, b.status AS base_status, o.status AS other_status, b.stage AS base_stage, o.stage AS other_stage FROM vruns b JOIN vruns o ON o.source = b.source AND b.n = 1 AND o.n = 2",
    "get_schema": "SELECT source, table_name, column_name, data_type FROM vschemas WHERE tbl_ord = 0",
    "compare_schema": "SELECT * FROM (SELECT coalesce(a.source, b.source) AS source, coalesce(a.column_name, b.column_name) AS column_name, CASE WHEN a.source IS NULL THEN 'added' WHEN b.source IS NULL THEN 'removed' WHEN a.data_type IS DISTINCT FROM b.data_type THEN 'retyped' END AS change, a.data_type AS old_type, b.data_type AS new_type FROM (SELECT * FROM vschemas WHERE tbl_ord = 0) a FULL JOIN (SELECT * FROM vschemas WHERE tbl_ord = 1) b ON a.source = b.source AND a.column_name = b.column_name) WHERE change IS NOT NULL AND source IN (SELECT source FROM vschemas GROUP BY source HAVING count(DISTINCT tbl_ord) = 2)",
    "schema_added_removed": "SELECT s.source, coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (WHERE first_in = 1), '') AS added, coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (WHERE last_in = 0), '') AS removed FROM (SELECT source, column_name, min(tbl_ord) AS first_in, max(tbl_ord) AS last_in FROM vschemas GROUP BY source, column_name) s WHERE s.source IN (SELECT source FROM vschemas GROUP BY source HAVING count(DISTINCT tbl_ord) = 2) GROUP BY s.source",
    "get_metrics": "SELECT source, name, shown FROM vmshown WHERE name IN ('error', 'purchase')",
    "stage_metrics": "SELECT m.source, m.name, m.shown FROM vmshown m LEFT JOIN cruns r ON r.source = m.source AND r.n = 1 WHERE r.stage IS NULL OR m.stage = r.stage",
    "executor_metrics": "SELECT source, name, shown FROM vmshown WHERE executor = '1'",
    "plan_preview": f"SELECT source, substr({redact('plan')}, 1, 2000) AS preview, length(plan) AS n_chars FROM vplans",
    "search_rules": "SELECT source, query, rank, rule_id FROM (SELECT o.source, split_part(o.category, '.', 1) AS query, r.rule_id, row_number() OVER (PARTITION BY o.source ORDER BY r.rule_id) AS rank FROM o_rank o JOIN rules r ON contains(lower(r.rule_id), split_part(o.category, '.', 1)) OR contains(lower(r.category), split_part(o.category, '.', 1)) OR contains(lower(r.rname), split_part(o.category, '.', 1)) WHERE o.rank = 1) WHERE rank <= 10",
    "plan_probes": "SELECT source, rule_id, probe_no, tool, arg1, arg2 FROM cprobe",
    "run_probes": "SELECT source, rule_id, probe_no, tool, arg1, arg2, status, n_lines FROM cresult",
    "verify_probes": "SELECT source, probe_no, tool, contradiction, supports FROM cverified",
    "investigate": "SELECT source, rule_id, status, tool_calls, CASE WHEN status = 'insufficient_context' THEN 'no structured context (runs/schemas/metrics/query plan/logs) was provided beyond the input file' WHEN contradicted THEN 'investigation found evidence contradicting ' || rule_id || '; the top explanation is challenged' WHEN status = 'limit_reached' THEN 'investigation stopped after 8 iteration(s)' ELSE 'investigation of the available structured context completed; no contradictory evidence found' END AS reason, contradicted, contradiction, contradicted_by FROM crecord",
}
STATEMENTS = {name: statement(sql) for name, sql in SQL.items()}
