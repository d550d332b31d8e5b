"""SQL for the queries over labelled cases and rule tables."""

from __future__ import annotations

import oracle.inputs  # noqa: F401 - defines the expressions over derived inputs
from logclinic.rules.catalog import FAMILIES
from oracle.base import CTES, cte, statement, values

cte("qcase", "SELECT source, kind, kind || '/' || tname AS label, status AS expected_status, ids AS expected_ids, CASE WHEN tname = 'spark-stage' THEN 'LOW' ELSE band END AS expected_band FROM inputs")
cte("qids", "SELECT source, string_agg(rule_id, ',' ORDER BY rank) AS ids, any_value(band) FILTER (WHERE rank = 1) AS band, any_value(score) FILTER (WHERE rank = 1) AS score FROM f_rank GROUP BY source")
cte("qgrade0", "SELECT c.*, o.status AS predicted_status, CASE WHEN o.status = 'input_error' THEN '' ELSE coalesce(i.ids, '') END AS matched_ids, i.band AS predicted_band, i.score AS top_score, i.source IS NOT NULL AS has_evidence FROM qcase c JOIN outcome o USING (source) LEFT JOIN qids i USING (source)")
_LIST = "'[' || replace({}, ',', ', ') || ']'"
_QUOTE = "coalesce('''' || {0} || '''', 'none')"
cte("qgrade", f"""SELECT *, concat_ws('; ', CASE WHEN predicted_status IS DISTINCT FROM expected_status THEN 'status ' || {_QUOTE.format('predicted_status')} || ' != expected ' || {_QUOTE.format('expected_status')} END, CASE WHEN matched_ids <> expected_ids THEN 'matches ' || {_LIST.format('matched_ids')} || ' != expected ' || {_LIST.format('expected_ids')} END, CASE WHEN expected_band IS NOT NULL AND predicted_band IS DISTINCT FROM expected_band THEN 'band ' || {_QUOTE.format('predicted_band')} || ' != expected ' || {_QUOTE.format('expected_band')} END) AS notes FROM qgrade0""")
cte("qbase", "SELECT source AS bname FROM inputs UNION ALL SELECT 'gone-' || item_id FROM benchmark")
cte("qregr", "SELECT bname FROM qbase WHERE bname NOT IN (SELECT source FROM qgrade WHERE notes = '')")


def ratio(hits: str, base: str) -> str:
    return f"round(count(*) FILTER (WHERE ({base}) AND ({hits}))::DOUBLE / nullif(count(*) FILTER (WHERE {base}), 0), 6)"


_OK, _EMIT, _POS = "notes = ''", "predicted_status = 'diagnosed'", "kind = 'positive'"
_ABSTAIN = "expected_status = 'input_error' OR expected_ids = ''"
_BANDED = f"{_POS} AND expected_band IS NOT NULL"
# user rules written from the part table
_BRAND = "replace(p_brand, '#', '')"
cte("urule0", f"""SELECT CASE WHEN p_size % 7 = 0 THEN lower(p_brand) || lpad((p_partkey % 1000)::VARCHAR, 3, '0') ELSE upper({_BRAND}) || '-' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') END AS rule_id, CASE WHEN p_size % 13 > 0 THEN p_name END AS rname, CASE WHEN p_size % 5 = 0 THEN p_type ELSE 'parts.' || lower(p_type) END AS category, CASE WHEN p_size % 11 = 0 THEN 'loud' ELSE 'medium' END AS severity, CASE p_size % 6 WHEN 0 THEN [] WHEN 1 THEN ['spark', 'spark'] WHEN 2 THEN ['Spark!'] ELSE ['spark'] END AS platforms, p_size % 4 = 0 AS no_exc, CASE p_size % 3 WHEN 0 THEN [] WHEN 1 THEN ['data_skew', 'data_skew'] ELSE ['executor_oom', 'Bad Signal'] END AS positive, CASE WHEN p_size % 2 = 0 THEN ['dns_failure'] ELSE ['no_such_' || lower({_BRAND})] END AS negative, p_size % 8 = 0 AS no_hyp, p_size % 9 = 0 AS no_ref FROM part""")
cte("urule", "SELECT * FROM urule0 WHERE rule_id IN (SELECT rule_id FROM urule0 GROUP BY rule_id HAVING count(*) = 1)")
cte("arule", "SELECT rule_id, rname, category, severity, platforms, no_exc, positive, negative, no_hyp, no_ref FROM urule UNION ALL SELECT r.rule_id, r.rname, r.category, r.severity, (SELECT list(platform ORDER BY ordinal) FROM rule_plat p WHERE p.rule_id = r.rule_id), r.rule_id NOT IN (SELECT rule_id FROM rule_exc), (SELECT list(signal ORDER BY ordinal) FROM rule_pos p WHERE p.rule_id = r.rule_id), coalesce((SELECT list(signal ORDER BY ordinal) FROM rule_neg p WHERE p.rule_id = r.rule_id), []), FALSE, FALSE FROM rules r")
CTES["family_title"] = values("family_title", "family, title, place", [(f, t, i + 1) for i, (f, t) in enumerate(FAMILIES.items())])
_SIGNALS = "list_concat(positive, negative)"
_CHECKS = {
    "invalid_id": r"NOT regexp_matches(rule_id, '^[A-Z0-9]+-\d{3}$')",
    "invalid_category": r"NOT regexp_matches(category, '^[a-z0-9]+(\.[a-z0-9_]+)*$')",
    "no_name": "rname IS NULL",
    "invalid_severity": "severity NOT IN ('critical', 'high', 'medium', 'low')",
    "no_platform": "len(platforms) = 0",
    "invalid_platform": "len(list_filter(platforms, lambda x: NOT regexp_matches(x, '^[a-z][a-z0-9_-]*$'))) > 0",
    "duplicate_platform": "len(list_distinct(platforms)) < len(platforms)",
    "invalid_signal": f"len(list_filter({_SIGNALS}, lambda x: NOT regexp_matches(x, '^[a-z][a-z0-9_]*$'))) > 0",
    "duplicate_signal": "len(list_distinct(positive)) < len(positive) OR len(list_distinct(negative)) < len(negative)",
    "no_trigger": "no_exc AND len(positive) = 0",
    "no_hypothesis": "no_hyp",
    "no_reference": "no_ref",
}
SQL = {
    "eval_cases": "SELECT source AS name, kind, label, expected_status, expected_ids, expected_band FROM qcase",
    "eval_grade": "SELECT source AS name, kind, predicted_status, matched_ids, predicted_band, top_score, has_evidence, has_evidence AS has_remediation, notes, notes = '' AS ok FROM qgrade",
    "eval_regressions": "SELECT bname AS name FROM qregr",
    "eval_metrics": f"SELECT count(*) AS total, count(*) FILTER (WHERE {_OK}) AS passed, count(*) FILTER (WHERE {_POS}) AS positive, count(*) FILTER (WHERE kind = 'negative') AS negative, count(*) FILTER (WHERE kind = 'malformed') AS malformed, {ratio(_OK, 'TRUE')} AS accuracy, {ratio(_OK, _EMIT)} AS precision, {ratio(_OK + ' AND ' + _EMIT, _POS)} AS recall, {ratio(_OK, _ABSTAIN)} AS abstention_quality, {ratio('predicted_band = expected_band', _BANDED)} AS confidence_calibration, {ratio('has_evidence', _EMIT)} AS evidence_coverage, {ratio('NOT has_evidence OR top_score < 40', _EMIT)} AS unsupported_claim_rate, {ratio('has_evidence', _EMIT)} AS remediation_coverage, round((SELECT count(*) FROM qregr)::DOUBLE / (SELECT count(*) FROM qbase), 6) AS regression_rate, NULL::DOUBLE AS tool_efficiency FROM qgrade",
    "baseline_roundtrip": "SELECT source AS name, notes = '' AS ok FROM qgrade",
    "rules_scan": "SELECT rule_id, len(positive) AS n_positive, NULL AS problem FROM urule UNION ALL SELECT rule_id, NULL, 'duplicate_id' FROM urule0 GROUP BY rule_id HAVING count(*) > 1",
    "validate_rules": " UNION ALL ".join(f"SELECT rule_id, '{name}' AS problem FROM arule WHERE {check}" for name, check in _CHECKS.items()),
    "validate_refs": "SELECT DISTINCT rule_id, 'unknown_signal' AS problem, s AS subject FROM (SELECT rule_id, unnest(list_concat(positive, negative)) AS s FROM arule) WHERE s NOT IN (SELECT signal FROM sigdef) UNION ALL SELECT NULL, 'unused_signal', signal FROM sigdef WHERE signal NOT IN (SELECT unnest(list_concat(positive, negative)) FROM arule) UNION ALL SELECT rule_id, 'no_positive_case', rule_id FROM arule WHERE rule_id NOT IN (SELECT unnest(string_split(expected_ids, ',')) FROM qcase WHERE kind = 'positive') UNION ALL SELECT 'SPARK-001', 'unknown_fixture', 'gone/' || item_id FROM benchmark",
    "catalog_list": "SELECT rule_id, rname AS name, category, severity, array_to_string(platforms, ', ') AS platforms FROM arule",
    "catalog_groups": f"SELECT g.family, n_rules, name_width, first_id, coalesce(t.title, upper(substr(g.family, 1, 1)) || lower(substr(g.family, 2))) AS title, coalesce(t.place, {len(FAMILIES) + 1}) AS place FROM (SELECT split_part(category, '.', 1) AS family, count(*) AS n_rules, max(length(rname)) AS name_width, min(rule_id) AS first_id FROM arule GROUP BY 1) g LEFT JOIN family_title t USING (family)",
}
_NAMED = "(SELECT *, split_part(category, '.', 1) AS family FROM arule WHERE rname IS NOT NULL)"
_TITLE = "coalesce(t.title, upper(substr(g.family, 1, 1)) || lower(substr(g.family, 2)))"
SQL["catalog_text"] = f"""SELECT g.family, coalesce(t.place, {len(FAMILIES) + 1}) AS place, {_TITLE} || ' (' || g.n || ')' || chr(10) || string_agg('  ' || rpad(r.rule_id, greatest(18, length(r.rule_id))::INTEGER, ' ') || ' ' || rpad(r.rname, g.width::INTEGER, ' ') || '  ' || rpad(r.severity, 8, ' ') || ' ' || array_to_string(r.platforms, ', '), chr(10) ORDER BY r.rule_id) AS text
FROM {_NAMED} r JOIN (SELECT family, count(*) AS n, max(length(rname)) AS width FROM {_NAMED} GROUP BY family) g USING (family) LEFT JOIN family_title t ON t.family = g.family GROUP BY g.family, t.place, t.title, g.n, g.width"""
_RATIOS = ["accuracy", "precision", "recall", "abstention_quality", "confidence_calibration", "evidence_coverage", "unsupported_claim_rate", "remediation_coverage", "regression_rate", "tool_efficiency"]
_SHOWN = " || chr(10) || ".join(f"'  ' || rpad('{r.replace('_', ' ')}', 25, ' ') || coalesce(printf('%.3f', {r}), 'n/a')" for r in _RATIOS)
_HEAD = "'Cases: ' || total || ' (' || positive || ' positive, ' || negative || ' negative, ' || malformed || ' malformed)' || chr(10) || 'Result: ' || passed || '/' || total || ' passed' || chr(10) || chr(10) || 'Metrics' || chr(10) || "
SQL["eval_render"] = f"""SELECT 'summary' AS section, '' AS name, {_HEAD}{_SHOWN} AS line FROM ({SQL['eval_metrics']})
UNION ALL SELECT 'failure', source, 'FAIL ' || source || ': ' || notes FROM qgrade WHERE notes <> '' UNION ALL SELECT 'regression', bname, 'REGRESSED ' || bname FROM qregr"""
STATEMENTS = {name: statement(sql) for name, sql in SQL.items()}
