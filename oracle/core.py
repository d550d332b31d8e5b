"""SQL for the queries over derived failure events."""

from __future__ import annotations

from oracle.base import LINE_BREAK, pylines, redact, statement, stripped

_BOTH = "(SELECT source, text FROM inputs UNION ALL SELECT 'd' || doc_id, text FROM documents)"
_FIRST = f"substr({stripped('split_part(excerpt, chr(32) || chr(124) || chr(32), 1)')}, 1, 160)"
_STATUS = "SELECT source, platform, event_count, error_types, n_matches, top_rule, top_score, top_band, status, message FROM {p}_report"

SQL = {
    "pool_text": f"""SELECT source, fine, part, count(*) AS n_events, coalesce(string_agg(t, chr(10) ORDER BY seq) FILTER (WHERE t <> ''), '') AS text FROM (
        SELECT *, (coalesce(sum(strlen(t) + 64) OVER (PARTITION BY source, fine ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000)::BIGINT AS part
        FROM (SELECT source, seq, (seq // 65536)::BIGINT AS fine, concat_ws(chr(10), {", ".join(f"nullif({c}, '')" for c in ("error_message", "stacktrace", "payload_text"))}) AS t FROM fe)
    ) GROUP BY source, fine, part""",
    "detect_platform": "SELECT source, text_platform AS platform FROM w_plat",
    "resolve_platform": "SELECT source, platform FROM w_plat",
    "annotate_events": "SELECT f.source, f.seq, CASE WHEN f.platform = 'unknown' THEN q.platform ELSE f.platform END AS platform, coalesce(f.error_type, x.first_exception) AS error_type FROM fe f JOIN w_plat q USING (source) LEFT JOIN w_first x USING (source)",
    "extract_exceptions": "SELECT source, exc AS exception FROM w_exc",
    "observed_exceptions": "SELECT source, exc AS exception FROM w_obs",
    "extract_signals": "SELECT source, signal FROM w_sig",
    "metadata_flag": "SELECT source, has_metadata FROM w_src",
    "match_positive": "SELECT source, rule_id, signal FROM w_mpos",
    "match_negative_anti": "SELECT m.source, m.rule_id, m.signal FROM w_mpos m WHERE NOT EXISTS (SELECT 1 FROM w_mneg n WHERE n.source = m.source AND n.rule_id = m.rule_id)",
    "match_exceptions": "SELECT source, rule_id, exc AS exception FROM w_mexc",
    "match_rules": "SELECT m.source, m.rule_id, m.platform, m.platform_match, (SELECT string_agg(s.signal, ',' ORDER BY s.signal) FROM w_mpos s WHERE s.source = m.source AND s.rule_id = m.rule_id) AS matched_signals, coalesce((SELECT string_agg(x.exc, ',' ORDER BY x.exc) FROM w_mexc x WHERE x.source = m.source AND x.rule_id = m.rule_id), '') AS matched_exceptions FROM w_match m",
    "enrich_matches": "SELECT s.source, s.rule_id, s.score, r.rname AS name, r.category, r.severity, (SELECT string_agg(p.platform, ',' ORDER BY p.ordinal) FROM rule_plat p WHERE p.rule_id = s.rule_id) AS platforms, (SELECT string_agg(h.hypothesis, ',' ORDER BY h.ordinal) FROM rule_hyp h WHERE h.rule_id = s.rule_id) AS hypotheses FROM w_score s JOIN rules r USING (rule_id)",
    "evidence_rows": "SELECT source, rule_id, ev_no, type, weight::BIGINT AS weight, description, origin, excerpt FROM w_ev",
    "evidence_dedupe": f"SELECT source, rule_id, ev_no, shown_line, CASE WHEN shown_line <> '' AND first_no < ev_no THEN first_no END AS same_as FROM (SELECT *, min(ev_no) OVER (PARTITION BY source, rule_id, shown_line) AS first_no FROM (SELECT source, rule_id, ev_no, coalesce({_FIRST}, '') AS shown_line FROM w_ev))",
    "score_evidence": "SELECT source, rule_id, score, n_evidence FROM w_score",
    "confidence_band": "SELECT band, count(*) AS n_matches, min(score) AS low, max(score) AS high FROM w_rank GROUP BY band",
    "signal_line": "SELECT m.source, m.rule_id, l.no AS line_no FROM w_match m LEFT JOIN w_sline l ON l.source = m.source AND l.rule_id = m.rule_id",
    "exception_line": "SELECT m.source, m.rule_id, l.no AS line_no FROM w_match m LEFT JOIN w_xline l ON l.source = m.source AND l.rule_id = m.rule_id",
    "evidence_excerpt": "SELECT source, rule_id, signal_excerpt, exception_excerpt FROM w_excerpt",
    "error_types": "SELECT source, error_types FROM w_report",
    "report_status": _STATUS.format(p="w"),
    "report_status_single": _STATUS.format(p="o"),
    "rank_matches": "SELECT source, rank, rule_id, score, band, severity_rank::BIGINT AS severity_rank FROM w_rank",
    "top_match": "SELECT source, rule_id, score, band FROM o_rank WHERE rank = 1",
    "redact_text": f"SELECT source, {redact('text')} AS text FROM {_BOTH}",
    "redact_lines": f"SELECT source, coalesce((SELECT string_agg(substr({redact('line')}, 1, 60), chr(10) ORDER BY i) FROM (SELECT unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i)), '') AS text FROM (SELECT source, {pylines('text')} AS l FROM inputs)",
    "number_lines": f"SELECT source, no, {stripped('line')} AS line FROM (SELECT source, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS no FROM (SELECT source, regexp_split_to_array(text, {LINE_BREAK}) AS l FROM {_BOTH})) WHERE {stripped('line')} <> ''",
}
STATEMENTS = {name: statement(sql) for name, sql in SQL.items()}
