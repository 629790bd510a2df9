"""DuckDB oracle statements, one per registered report (same output columns).

They restate each report in plain SQL over the driver tables (single-level
window forms, no bucketing tricks) so the driver can compare results.
"""

from __future__ import annotations

from .oracle_views import (ALERTS_V, CASE_VECTORS_V, CASES_V, INGEST_KEYS_V, LOG_FILES_V, LOG_LINES_V,
                           LOGS_V, METRICS_V, TEAMS_V, TRACES_V, USERS_V, with_views)

GAP_US = 1_800_000_000

ISO = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def iso(x: str) -> str:
    return ISO.format(x)


BREACHES = """mb AS (
  SELECT org_id, service, 'error_rate' AS metric, CAST(error_rate AS DOUBLE) AS value, ts,
         CASE WHEN error_rate >= 0.300 THEN 'critical' ELSE 'warning' END AS severity,
         CAST(NULL AS VARCHAR) AS event, CAST(NULL AS VARCHAR) AS message, CAST(NULL AS VARCHAR) AS trace_id,
         0 AS seq, id AS src_id, 0 AS sub
  FROM metrics_v WHERE error_rate >= 0.150
  UNION ALL
  SELECT org_id, service, 'p99_latency_ms', CAST(p99_latency_ms AS DOUBLE), ts,
         CASE WHEN p99_latency_ms >= 1600.1 THEN 'critical' ELSE 'warning' END,
         NULL, NULL, NULL, 0, id, 1
  FROM metrics_v WHERE p99_latency_ms >= 800.1
  UNION ALL
  SELECT org_id, service, 'active_connections', CAST(active_connections AS DOUBLE), ts,
         CASE WHEN active_connections >= 37 THEN 'critical' ELSE 'warning' END,
         NULL, NULL, NULL, 0, id, 2
  FROM metrics_v WHERE active_connections >= 19),
rss AS (
  SELECT org_id, service, ts, id, rss_mb AS v,
         (epoch_us(ts) // 3600000000 - k) * 3600000000 AS ws
  FROM metrics_v, range(0, 6) AS r(k) WHERE rss_mb IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY org_id, service, ws ORDER BY ts, id) - 1 AS rn,
         count(*) OVER (PARTITION BY org_id, service, ws) AS n
  FROM rss),
tr AS (
  SELECT org_id, service, ws, n,
         CAST(sum(v) FILTER (rn < n // 2) AS DOUBLE) / count(v) FILTER (rn < n // 2) AS a1, CAST(sum(v) FILTER (rn >= n // 2) AS DOUBLE) / count(v) FILTER (rn >= n // 2) AS a2,
         epoch_us(min(ts)) AS f, epoch_us(max(ts)) AS l, max(ts) AS last_ts
  FROM ranked GROUP BY org_id, service, ws, n),
trend AS (
  SELECT org_id, service, 'rss_mb' AS metric, (a2 - a1) / ((l - f) / 60000000.0) AS value, last_ts AS ts,
         'warning' AS severity, CAST(NULL AS VARCHAR) AS event, CAST(NULL AS VARCHAR) AS message,
         CAST(NULL AS VARCHAR) AS trace_id, 1 AS seq, CAST(-1 AS BIGINT) AS src_id, 0 AS sub
  FROM tr
  WHERE n >= 4 AND l > f AND (a2 - a1) / ((l - f) / 60000000.0) >= 0.1 AND a2 >= 150.0),
lb AS (
  SELECT org_id, service, 'log_error' AS metric, CAST(1.0 AS DOUBLE) AS value, ts, 'critical' AS severity,
         event, message, trace_id, 2 AS seq, id AS src_id, 0 AS sub
  FROM logs_v WHERE level IN ('ERROR', 'CRITICAL')),
breaches AS (
  SELECT * FROM mb UNION ALL SELECT * FROM trend UNION ALL SELECT * FROM lb)"""

GROUPED = f"""g1 AS (
  SELECT *, epoch_us(ts) AS us,
         lag(epoch_us(ts)) OVER (PARTITION BY org_id, service ORDER BY epoch_us(ts), seq, src_id, sub) AS prev
  FROM breaches),
grouped AS (
  SELECT *, max(CASE WHEN prev IS NULL OR us - prev > {GAP_US} THEN us END)
              OVER (PARTITION BY org_id, service ORDER BY us, seq, src_id, sub
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gs
  FROM g1)"""

SIGNATURES = """firsts AS (
  SELECT org_id, service, gs, message, us, seq, src_id, sub,
         row_number() OVER (PARTITION BY org_id, service, gs, message ORDER BY us, seq, src_id, sub) AS r1
  FROM grouped WHERE severity = 'critical' AND message IS NOT NULL AND message <> ''),
samples AS (
  SELECT org_id, service, gs,
         string_agg(left(message, 200), '; ' ORDER BY us, seq, src_id, sub) AS samples
  FROM (SELECT *, row_number() OVER (PARTITION BY org_id, service, gs ORDER BY us, seq, src_id, sub) AS r2
        FROM firsts WHERE r1 = 1) t
  WHERE r2 <= 2
  GROUP BY org_id, service, gs),
roll AS (
  SELECT org_id, service, gs, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_breaches,
         CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END AS severity,
         list_sort(list_distinct(list(metric))) AS metrics,
         list_sort(list_distinct(list(event) FILTER (WHERE event IS NOT NULL AND event <> ''))) AS events
  FROM grouped GROUP BY org_id, service, gs),
sig AS (
  SELECT r.*, s.samples,
         concat_ws('; ', 'service=' || r.service,
                   'metrics=[' || array_to_string(r.metrics, ', ') || ']',
                   CASE WHEN len(r.events) > 0 THEN 'events=[' || array_to_string(r.events, ', ') || ']' END,
                   'severity=' || r.severity,
                   CASE WHEN s.samples IS NOT NULL THEN 'sample_messages="' || s.samples || '"' END)
           AS signature_text
  FROM roll r LEFT JOIN samples s USING (org_id, service, gs))"""

ORACLE: dict[str, str] = {}

ORACLE["breach_group_rollup"] = with_views(METRICS_V, LOGS_V) + ",\n".join([BREACHES, GROUPED, SIGNATURES]) + f"""
SELECT org_id, service, {iso('first_ts')} AS first_ts, {iso('last_ts')} AS last_ts, n_breaches, severity,
       array_to_string(metrics, ',') AS metrics, coalesce(array_to_string(events, ','), '') AS events,
       signature_text
FROM sig"""

MB = BREACHES.split(",\nrss AS (")[0]
LB = "lb AS (" + BREACHES.split(",\nlb AS (")[1].split(",\nbreaches AS (")[0]
TREND_ALL = """rss AS (
  SELECT org_id, service, ts, rss_mb AS v,
         row_number() OVER (PARTITION BY org_id, service ORDER BY ts, id) - 1 AS rn,
         count(*) OVER (PARTITION BY org_id, service) AS n
  FROM metrics_v WHERE rss_mb IS NOT NULL),
tr AS (
  SELECT org_id, service, n,
         CAST(sum(v) FILTER (rn < n // 2) AS DOUBLE) / count(v) FILTER (rn < n // 2) AS a1,
         CAST(sum(v) FILTER (rn >= n // 2) AS DOUBLE) / count(v) FILTER (rn >= n // 2) AS a2,
         epoch_us(min(ts)) AS f, epoch_us(max(ts)) AS l, max(ts) AS last_ts
  FROM rss GROUP BY org_id, service, n),
trend AS (
  SELECT org_id, service, 'rss_mb' AS metric, (a2 - a1) / ((l - f) / 60000000.0) AS value, last_ts AS ts,
         'warning' AS severity, CAST(NULL AS VARCHAR) AS event, CAST(NULL AS VARCHAR) AS message,
         CAST(NULL AS VARCHAR) AS trace_id, 1 AS seq, CAST(-1 AS BIGINT) AS src_id, 0 AS sub
  FROM tr
  WHERE n >= 4 AND l > f AND (a2 - a1) / ((l - f) / 60000000.0) >= 0.00005 AND a2 >= 160.0)"""


def breach_select(src: str, where: str = "TRUE") -> str:
    return (f"SELECT org_id, service, metric, round(value, 6) AS value, {iso('ts')} AS ts, severity, event, "
            f"message, trace_id, seq, src_id FROM {src} WHERE {where}")


ORACLE["detect_error_rate"] = with_views(METRICS_V) + MB + "\n" + breach_select("mb", "metric = 'error_rate'")
ORACLE["detect_p99"] = with_views(METRICS_V) + MB + "\n" + breach_select("mb", "metric = 'p99_latency_ms'")
ORACLE["detect_connections"] = with_views(METRICS_V) + MB + "\n" + breach_select("mb", "metric = 'active_connections'")
ORACLE["detect_metric_breaches"] = with_views(METRICS_V) + MB + "\n" + breach_select("mb")
ORACLE["detect_rule_rows"] = with_views(METRICS_V) + f"""rules(rule_id, metric, warn_from, critical_from) AS (VALUES
  (0, 'error_rate', 0.150, 0.300), (1, 'p99_latency_ms', 800.1, 1600.1), (2, 'active_connections', 19, 37),
  (3, 'p99_latency_ms', 1200.1, 2400.1), (4, 'rss_mb', 180.1, 360.1)),
long AS (
  SELECT id, org_id, service, ts, 'error_rate' AS metric, CAST(error_rate AS DECIMAL(18,3)) AS v FROM metrics_v
  UNION ALL SELECT id, org_id, service, ts, 'p99_latency_ms', CAST(p99_latency_ms AS DECIMAL(18,3)) FROM metrics_v
  UNION ALL SELECT id, org_id, service, ts, 'active_connections', CAST(active_connections AS DECIMAL(18,3)) FROM metrics_v
  UNION ALL SELECT id, org_id, service, ts, 'rss_mb', CAST(rss_mb AS DECIMAL(18,3)) FROM metrics_v)
SELECT CAST(r.rule_id AS INTEGER) AS rule_id, l.org_id, l.service, l.metric, round(CAST(l.v AS DOUBLE), 6) AS value, {iso('l.ts')} AS ts,
  CASE WHEN l.v >= r.critical_from THEN 'critical' ELSE 'warning' END AS severity, l.id AS src_id
FROM long l JOIN rules r ON r.metric = l.metric AND l.v >= r.warn_from"""
ORACLE["detect_rss_trend"] = with_views(METRICS_V) + TREND_ALL + "\n" + breach_select("trend")
ORACLE["detect_error_logs"] = with_views(LOGS_V) + LB + "\n" + breach_select("lb")
ORACLE["all_breaches"] = with_views(METRICS_V, LOGS_V) + BREACHES + "\n" + breach_select("breaches")
ORACLE["breach_groups"] = with_views(METRICS_V, LOGS_V) + BREACHES + ",\n" + GROUPED + f"""
SELECT org_id, service, metric, {iso('ts')} AS ts, seq, src_id, sub, {iso('make_timestamp(gs)')} AS group_start
FROM grouped"""
ORACLE["signature_text"] = with_views(METRICS_V, LOGS_V) + ",\n".join([BREACHES, GROUPED, SIGNATURES]) + f"""
SELECT org_id, service, {iso('first_ts')} AS first_ts, signature_text FROM sig"""

ORACLE["detect_rss_trend_sliding"] = with_views(METRICS_V) + f"""rssw AS (
  SELECT org_id, service, ts, id, rss_mb AS v,
         (epoch_us(ts) // 3600000000 - k) * 3600000000 AS ws
  FROM metrics_v, range(0, 6) AS r(k) WHERE rss_mb IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY org_id, service, ws ORDER BY ts, id) - 1 AS rn,
         count(*) OVER (PARTITION BY org_id, service, ws) AS n
  FROM rssw),
st AS (
  SELECT org_id, service, ws, n,
         CAST(sum(v) FILTER (rn < n // 2) AS DOUBLE) / count(v) FILTER (rn < n // 2) AS a1, CAST(sum(v) FILTER (rn >= n // 2) AS DOUBLE) / count(v) FILTER (rn >= n // 2) AS a2,
         epoch_us(min(ts)) AS f, epoch_us(max(ts)) AS l, max(ts) AS last_ts
  FROM ranked GROUP BY org_id, service, ws, n)
SELECT org_id, service, {iso('make_timestamp(ws)')} AS win_start,
       round((a2 - a1) / ((l - f) / 60000000.0), 6) AS value, {iso('last_ts')} AS ts, 'warning' AS severity
FROM st
WHERE n >= 4 AND l > f AND (a2 - a1) / ((l - f) / 60000000.0) >= 0.1 AND a2 >= 150.0"""

ORACLE["service_catalog"] = with_views(LOG_LINES_V) + f"""seen AS (
  SELECT ts, app, regexp_extract(line, '\\[([^\\]]+)\\]', 1) AS service FROM log_lines_v),
firsts AS (
  SELECT 'app' AS kind, app AS value, min(ts) AS fs FROM seen WHERE app IS NOT NULL AND app <> '' GROUP BY app
  UNION ALL
  SELECT 'service', service, min(ts) FROM seen WHERE service IS NOT NULL AND service <> '' GROUP BY service)
SELECT coalesce(array_to_string(list_sort(list(value) FILTER (WHERE kind = 'app')), ','), '') AS apps,
       coalesce(array_to_string(list_sort(list(value) FILTER (WHERE kind = 'service')), ','), '') AS services,
       {iso('max(fs)')} AS last_updated
FROM firsts"""

ORACLE["log_totals"] = with_views(LOG_LINES_V).rstrip().rstrip(",") + """
SELECT count(*) AS total,
       count(*) FILTER (WHERE contains(line, 'WARN')) AS warn,
       count(*) FILTER (WHERE regexp_matches(line, 'ERROR|CRITICAL')) AS error_or_critical
FROM log_lines_v"""

ORACLE["log_level_series"] = with_views(LOG_LINES_V).rstrip().rstrip(",") + f"""
SELECT {iso("date_trunc('hour', ts)")} AS bucket_start,
       count(*) FILTER (WHERE contains(line, 'INFO')) AS info,
       count(*) FILTER (WHERE contains(line, 'WARN')) AS warn,
       count(*) FILTER (WHERE contains(line, 'ERROR')) AS error,
       count(*) FILTER (WHERE contains(line, 'CRITICAL')) AS critical
FROM log_lines_v GROUP BY date_trunc('hour', ts)"""

ORACLE["log_volume_series"] = with_views(LOG_LINES_V).rstrip().rstrip(",") + f"""
SELECT app || '.log' AS filename, {iso("date_trunc('hour', ts)")} AS bucket_start, count(*) AS lines
FROM log_lines_v GROUP BY app || '.log', date_trunc('hour', ts)"""

ORACLE["latest_errors"] = with_views(LOG_LINES_V).rstrip().rstrip(",") + f"""
SELECT line_id, {iso('ts')} AS ts, line FROM log_lines_v
WHERE regexp_matches(line, 'ERROR|CRITICAL') ORDER BY ts DESC, line_id DESC LIMIT 100"""

ORACLE["table_counts"] = """
SELECT 'metrics' AS tbl, count(*) AS n FROM events
UNION ALL SELECT 'logs', count(*) FROM events
UNION ALL SELECT 'traces', count(*) FROM events
UNION ALL SELECT 'cases', count(*) FROM orders
UNION ALL SELECT 'alerts', count(*) FROM lineitem"""

ORACLE["alert_time_buckets"] = with_views(METRICS_V, LOGS_V) + BREACHES + f"""
SELECT org_id, service || '|' || metric || '|' || CAST(epoch_us(ts) // {GAP_US} AS VARCHAR) AS dedup_key,
       count(*) AS n, {iso('min(ts)')} AS first_ts
FROM breaches GROUP BY ALL"""

ORACLE["recent_logs"] = with_views(LOGS_V).rstrip().rstrip(",") + f"""
SELECT id, {iso('ts')} AS ts, service, level, event, trace_id, message FROM logs_v
WHERE org_id = 'org-1' ORDER BY logs_v.ts DESC NULLS FIRST, id DESC LIMIT 100"""

ORACLE["recent_traces"] = with_views(TRACES_V).rstrip().rstrip(",") + f"""
SELECT id, {iso('ts')} AS ts, trace_id, service, span_name, round(CAST(duration_ms AS DOUBLE), 6) AS duration_ms,
       is_error, error_code
FROM traces_v WHERE service = 'svc-2' AND org_id = 'org-0'
ORDER BY traces_v.ts DESC NULLS FIRST, id DESC LIMIT 50"""

ORACLE["recent_metrics"] = with_views(METRICS_V).rstrip().rstrip(",") + f"""
SELECT id, {iso('ts')} AS ts, service, round(CAST(error_rate AS DOUBLE), 6) AS error_rate,
       round(CAST(p99_latency_ms AS DOUBLE), 6) AS p99_latency_ms, active_connections,
       round(CAST(rss_mb AS DOUBLE), 6) AS rss_mb, org_id
FROM metrics_v WHERE service = 'svc-3' ORDER BY metrics_v.ts DESC NULLS FIRST, id DESC LIMIT 100"""

ORACLE["trace_by_id"] = with_views(TRACES_V).rstrip().rstrip(",") + f"""
SELECT id, {iso('ts')} AS ts, trace_id, service, span_name, is_error, error_code
FROM traces_v WHERE trace_id = 't42'"""

ORACLE["list_cases"] = with_views(CASES_V).rstrip().rstrip(",") + f"""
SELECT id, org_id, status, primary_service, {iso('opened_at')} AS opened_at, {iso('updated_at')} AS updated_at, severity,
  title
FROM cases_v WHERE org_id = 'org-2' AND status = 'OPEN'
ORDER BY cases_v.opened_at DESC NULLS FIRST, id DESC LIMIT 100"""

ORACLE["list_alerts"] = with_views(ALERTS_V).rstrip().rstrip(",") + f"""
SELECT id, case_id, service, metric, severity, {iso('triggered_at')} AS triggered_at,
       {iso('received_at')} AS received_at, duplicate_count
FROM alerts_v WHERE service = 'svc-1' ORDER BY alerts_v.triggered_at DESC NULLS FIRST, id DESC LIMIT 100"""

OPEN_WITH_ALERTS = f"""top AS (
  SELECT * FROM cases_v WHERE status <> 'RESOLVED' AND org_id = 'org-1' @service@
  ORDER BY opened_at DESC NULLS FIRST, id DESC LIMIT @limit@)
SELECT t.id, t.status, {iso('t.opened_at')} AS opened_at, count(a.id) AS n_alerts,
       coalesce(string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.triggered_at, a.id), '') AS alert_ids
FROM top t LEFT JOIN alerts_v a ON a.case_id = t.id
GROUP BY t.id, t.status, t.opened_at"""

ORACLE["open_cases_with_alerts"] = with_views(CASES_V, ALERTS_V) + OPEN_WITH_ALERTS.replace("@service@", "").replace(
    "@limit@", "50")
ORACLE["open_service_cases_with_alerts"] = with_views(CASES_V, ALERTS_V) + OPEN_WITH_ALERTS.replace(
    "@service@", "AND primary_service = 'svc-2'").replace("@limit@", "5")

ORACLE["case_by_id"] = with_views(CASES_V).rstrip().rstrip(",") + f"""
SELECT id, org_id, status, primary_service, {iso('opened_at')} AS opened_at, title FROM cases_v WHERE id = 7"""

ALERT_ROWS = f"""
SELECT id, case_id, service, metric, severity, {iso('triggered_at')} AS triggered_at,
       {iso('received_at')} AS received_at, duplicate_count FROM alerts_v"""
ORACLE["alerts_of_case"] = with_views(ALERTS_V).rstrip().rstrip(",") + ALERT_ROWS + """
WHERE case_id = 7 ORDER BY alerts_v.triggered_at DESC NULLS FIRST, id DESC LIMIT 100"""
ORACLE["alert_by_id"] = with_views(ALERTS_V).rstrip().rstrip(",") + ALERT_ROWS + " WHERE id = 60"

# ---------------------------------------------------------------- parsing

from .oracle_views import ENVELOPES_V  # noqa: E402

HEAD_RE = r"^\S+\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+(.*)$"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def parse_lines_sql(src: str, ids: str) -> str:
    """CTEs ``parsed`` (ids, level, service, message, p) and ``ctx`` (ids, key, value, first_i)."""
    return f"""parts AS (SELECT {ids}, string_split(line, ' | ') AS p FROM {src}),
parsed AS (
  SELECT {ids}, p, regexp_extract(p[1], '{HEAD_RE}', 1) AS level,
         regexp_extract(p[1], '{HEAD_RE}', 2) AS service, regexp_extract(p[1], '{HEAD_RE}', 3) AS message
  FROM parts WHERE regexp_matches(p[1], '{HEAD_RE}')),
pieces AS (
  SELECT {ids}, unnest(p[2:]) AS piece, generate_subscripts(p[2:], 1) AS i FROM parsed),
kv AS (
  SELECT {ids}, i, {trim_ws("split_part(piece, '=', 1)")} AS key,
         {trim_ws("substr(piece, instr(piece, '=') + 1)")} AS value
  FROM pieces WHERE contains(piece, '=')),
ctx AS (
  SELECT {ids}, key, arg_max(value, i) AS value, min(i) AS first_i FROM kv GROUP BY {ids}, key),
ctxtext AS (
  SELECT {ids}, string_agg(key || '=' || value, ';' ORDER BY key || '=' || value) AS context,
         max(CASE WHEN key = 'trace_id' THEN value END) AS trace_id
  FROM ctx GROUP BY {ids})"""


def slug_sql(x: str) -> str:
    return (f"coalesce(nullif(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), "
            f"'^_+|_+$', '', 'g'), ''), 'alert')")


def pyiso_sql(x: str) -> str:
    return (f"(strftime({x}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({x}) % 1000000 <> 0 THEN '.' || "
            f"lpad(CAST(epoch_us({x}) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00')")


ORACLE["parse_log_lines"] = with_views(LOG_LINES_V) + parse_lines_sql("log_lines_v", "line_id") + """
SELECT p.line_id, p.level, p.service, p.message, c.trace_id, c.context
FROM parsed p LEFT JOIN ctxtext c USING (line_id)"""

ORACLE["parse_log_context"] = with_views(LOG_LINES_V) + parse_lines_sql("log_lines_v", "line_id") + """
SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY first_i) - 1 AS pos, key, value FROM ctx"""

ORACLE["slugify_events"] = with_views(CASES_V).rstrip().rstrip(",") + f"""
SELECT id, title, {slug_sql('title')} AS slug FROM cases_v"""

CASE_REFS = """refs AS (
  SELECT id, CASE WHEN id % 3 = 0 THEN printf('CASE-%04d', id)
                  WHEN id % 3 = 1 THEN CAST(id AS VARCHAR)
                  ELSE 'CASE-x' || CAST(id AS VARCHAR) END AS ref
  FROM cases_v)"""

ORACLE["parse_case_ids"] = with_views(CASES_V) + CASE_REFS + """
SELECT ref, TRY_CAST(string_split(ref, '-')[-1] AS BIGINT) AS case_id FROM refs"""

ORACLE["json_fields"] = with_views(LOGS_V).rstrip().rstrip(",") + """
SELECT id, CAST(json_extract_string(context, '$.k') AS BIGINT) AS k, len(json_keys(context)) AS n_keys
FROM logs_v"""

ORACLE["alert_payloads"] = with_views(METRICS_V, LOGS_V) + BREACHES + f"""
SELECT org_id, seq, src_id, metric,
       CAST(json_object('service', service, 'metric', metric, 'value', value, 'ts', {pyiso_sql('ts')},
                        'severity', severity, 'event', event, 'message', message, 'trace_id', trace_id)
            AS VARCHAR) AS raw_payload
FROM breaches"""

MODEL_OUTPUTS = """mo AS (
  SELECT id AS case_id,
         CASE WHEN id % 8 = 7 THEN '{"title": "' || coalesce(title, 'untitled') || '", '
              WHEN id % 4 = 0 THEN '```json' || chr(10) || body || chr(10) || '```'
              WHEN id % 4 = 1 THEN body
              WHEN id % 4 = 2 THEN '```' || chr(10) || body || '```'
              ELSE '  ' || body || chr(10) END AS response
  FROM (SELECT *, '{"title":"' || coalesce(title, 'untitled') || '","hypotheses":[{"rank":1,"text":"'
                  || primary_service || ' saturated","confidence":' || CAST(id % 100 AS VARCHAR)
                  || '}],"evidence":[{"type":"log","label":"' || status || '","text":"seen"}],"ai_summary":"'
                  || coalesce(ai_summary, '') || '"}' AS body
        FROM cases_v) b),
cleaned AS (
  SELECT case_id, """ + trim_ws(
    "regexp_replace(regexp_replace(" + trim_ws("response") + ", '^```[a-z]*\\n?', ''), '\\n?```$', '')") + """ AS t
  FROM mo)"""

ORACLE["parse_model_json"] = with_views(CASES_V) + MODEL_OUTPUTS + """
SELECT case_id, json_valid(t) AS ok,
       CASE WHEN json_valid(t) THEN json_extract_string(t, '$.title') END AS title,
       CASE WHEN json_valid(t) THEN CAST(json_array_length(t, '$.hypotheses') AS INTEGER) END AS n_hypotheses,
       CASE WHEN json_valid(t) THEN json_extract_string(t, '$.hypotheses[0].text') END AS first_hypothesis,
       CASE WHEN json_valid(t) THEN CAST(json_extract(t, '$.hypotheses[0].confidence') AS INTEGER) END AS confidence,
       CASE WHEN json_valid(t) THEN json_extract_string(t, '$.ai_summary') END AS ai_summary
FROM cleaned"""

ORACLE["model_answers"] = with_views(CASES_V) + """told AS (
  SELECT id AS case_id, id % 13 = 5 AS none, id % 11 = 3 AS missing, id % 8 = 7 AS bad, id % 16 = 15 AS worse FROM cases_v),
judged AS (
  SELECT case_id, bad AND NOT none AND NOT missing AS again,
    CASE WHEN none THEN 'no answer' WHEN missing THEN 'missing field' WHEN bad AND worse THEN 'malformed' END AS reason
  FROM told)
SELECT case_id, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN again THEN 'retried' ELSE 'ok' END AS outcome, reason,
  CASE WHEN again THEN 2 ELSE 1 END AS rounds,
  CASE WHEN reason IS NULL THEN 'case ' || case_id END AS title,
  CASE WHEN reason IS NULL THEN CAST(case_id % 100 AS INTEGER) END AS confidence,
  CASE WHEN reason IS NULL THEN CASE WHEN again THEN 'short' ELSE 'full' END END AS ai_summary
FROM judged"""

ALERTS_SQL = """env AS (
  SELECT env_id, ts, org_id, payload,
         CASE WHEN json_extract(payload, '$.alerts') IS NULL THEN [CAST(payload AS JSON)]
              ELSE CAST(json_extract(payload, '$.alerts') AS JSON[]) END AS alist
  FROM envelopes_v),
al AS (SELECT env_id, ts, org_id, unnest(alist) AS a, generate_subscripts(alist, 1) - 1 AS pos FROM env),
alf AS (
  SELECT env_id, ts, org_id, pos, coalesce(json_extract_string(a, '$.status'), 'firing') AS status,
         json_extract_string(a, '$.labels.alertname') AS alertname,
         coalesce(nullif(json_extract_string(a, '$.labels.service_name'), ''),
                  nullif(json_extract_string(a, '$.labels.service'), '')) AS service,
         coalesce(nullif(json_extract_string(a, '$.labels.app'), ''),
                  nullif(json_extract_string(a, '$.labels.job'), '')) AS app
  FROM al),
fr AS (SELECT *, row_number() OVER (PARTITION BY env_id ORDER BY pos) AS fpos FROM alf WHERE status = 'firing'),
lim AS (
  SELECT env_id, coalesce(min(fpos) FILTER (WHERE service IS NOT NULL), max(fpos)) AS last_pos
  FROM fr GROUP BY env_id),
names AS (
  SELECT fr.env_id, arg_min(fr.alertname, fr.fpos) AS alertname
  FROM fr JOIN lim USING (env_id)
  WHERE fr.fpos <= lim.last_pos AND fr.alertname IS NOT NULL AND fr.alertname <> ''
  GROUP BY fr.env_id),
hdr AS (
  SELECT l.env_id, f.ts, f.org_id, f.service, f.app, n.alertname
  FROM lim l JOIN fr f ON f.env_id = l.env_id AND f.fpos = l.last_pos
  LEFT JOIN names n ON n.env_id = l.env_id)"""

ORACLE["firing_alerts"] = with_views(LOG_LINES_V, ENVELOPES_V) + ALERTS_SQL + """
SELECT env_id, pos, status, alertname, service, app FROM fr"""

ORACLE["alert_header"] = with_views(LOG_LINES_V, ENVELOPES_V) + ALERTS_SQL + """
SELECT env_id, service, app, alertname FROM hdr"""

ORACLE["alert_to_logs"] = with_views(LOG_LINES_V, ENVELOPES_V) + ALERTS_SQL + f""",
lines AS (
  SELECT h.env_id, h.alertname, unnest(CAST(json_extract(e.payload, '$.context.logs') AS VARCHAR[])) AS line,
         generate_subscripts(CAST(json_extract(e.payload, '$.context.logs') AS VARCHAR[]), 1) - 1 AS pos
  FROM hdr h JOIN envelopes_v e USING (env_id)),
""" + parse_lines_sql("lines", "env_id, pos") + f"""
SELECT p.env_id, p.pos, p.level, p.service, {slug_sql('l.alertname')} AS event, p.message, c.trace_id, c.context
FROM parsed p JOIN lines l USING (env_id, pos) LEFT JOIN ctxtext c USING (env_id, pos)"""

ORACLE["service_catalog"] = with_views(LOG_LINES_V, ENVELOPES_V) + ALERTS_SQL + f""",
firsts AS (
  SELECT 'app' AS kind, app AS value, min(ts) AS fs FROM hdr WHERE app IS NOT NULL AND app <> '' GROUP BY app
  UNION ALL
  SELECT 'service', service, min(ts) FROM hdr WHERE service IS NOT NULL AND service <> '' GROUP BY service)
SELECT coalesce(array_to_string(list_sort(list(value) FILTER (WHERE kind = 'app')), ','), '') AS apps,
       coalesce(array_to_string(list_sort(list(value) FILTER (WHERE kind = 'service')), ','), '') AS services,
       {iso('max(fs)')} AS last_updated
FROM firsts"""

# ---------------------------------------------------------------- similarity

PAIRS = """pairs AS (
  SELECT q.case_id AS qid, i.case_id AS iid, q.org_id AS qorg, q.service AS qsvc, i.org_id AS iorg,
         i.service AS isvc,
         list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(i.vector AS DOUBLE[])) AS score
  FROM case_vectors_v q JOIN case_vectors_v i ON q.case_id <> i.case_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, iid) AS rk FROM pairs)"""

ORACLE["vector_topk"] = with_views(CASE_VECTORS_V) + PAIRS + """
SELECT qid AS case_id, rk AS rank, iid AS match_id, round(score, 6) AS score FROM ranked WHERE rk <= 5"""

ORACLE["dedup_post_filter"] = with_views(CASE_VECTORS_V) + PAIRS + """,
hit AS (
  SELECT qid, arg_min(iid, rk) AS iid, arg_min(score, rk) AS score
  FROM ranked WHERE rk <= 5 AND iorg = qorg AND isvc = qsvc GROUP BY qid)
SELECT q.case_id, CASE WHEN h.score >= 0.30 THEN h.iid END AS matched_case_id, round(h.score, 6) AS score,
       coalesce(h.score >= 0.30, false) AS is_duplicate
FROM case_vectors_v q LEFT JOIN hit h ON h.qid = q.case_id"""

ORACLE["dedup_pre_filter"] = with_views(CASE_VECTORS_V) + """pairs AS (
  SELECT q.case_id AS qid, i.case_id AS iid,
         list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(i.vector AS DOUBLE[])) AS score
  FROM case_vectors_v q JOIN case_vectors_v i
    ON q.case_id <> i.case_id AND q.org_id = i.org_id AND q.service = i.service),
hit AS (SELECT qid, arg_max(iid, score) AS iid, max(score) AS score FROM pairs GROUP BY qid)
SELECT q.case_id, CASE WHEN h.score >= 0.30 THEN h.iid END AS matched_case_id, round(h.score, 6) AS score,
       coalesce(h.score >= 0.30, false) AS is_duplicate
FROM case_vectors_v q LEFT JOIN hit h ON h.qid = q.case_id"""

ORACLE["action_match"] = with_views(CASE_VECTORS_V) + """comp AS (
  SELECT label, pos, avg(x) AS m
  FROM (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM case_vectors_v) t
  GROUP BY label, pos),
norms AS (SELECT label, sqrt(sum(m * m)) AS nrm FROM comp GROUP BY label),
cat AS (SELECT c.label, list(c.m / n.nrm ORDER BY c.pos) AS v FROM comp c JOIN norms n USING (label) GROUP BY c.label),
sc AS (
  SELECT q.case_id, c.label AS action_id, list_dot_product(CAST(q.vector AS DOUBLE[]), c.v) AS score
  FROM case_vectors_v q JOIN cat c ON TRUE),
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, action_id) AS rank FROM sc)
SELECT case_id, rank, action_id, round(score, 6) AS score FROM rk WHERE rank <= 3"""

# ---------------------------------------------------------------- teams, cases, tenancy, traces

from ..functions.catalog_data import action_types_sql  # noqa: E402
from .oracle_views import INGEST_REQUESTS_V, ORGS_V  # noqa: E402

ACTION_MATCH_CTES = ORACLE["action_match"].split("\nSELECT case_id, rank, action_id")[0].split("WITH ", 1)[1]
CASE_ACTIONS = ACTION_MATCH_CTES + """,
case_actions AS (
  SELECT case_id, CAST(action_id + 1 AS INTEGER) AS action_id,
         CAST(round(score, 6) AS DECIMAL(5,4)) AS similarity_score
  FROM rk WHERE rank <= 3)"""

ORACLE["case_actions_ranked"] = "WITH " + CASE_ACTIONS + f"""
SELECT ca.case_id, ca.action_id, a.name, a.action_type, round(CAST(ca.similarity_score AS DOUBLE), 6) AS score
FROM case_actions ca JOIN {action_types_sql()} ON a_id = ca.action_id""".replace(
    "AS actions(id, name, action_type)", "AS a(a_id, name, action_type)")

ORACLE["users_with_teams"] = with_views(USERS_V, TEAMS_V).rstrip().rstrip(",") + """
SELECT u.id, u.name, u.role, t.name AS team_name
FROM users_v u LEFT JOIN teams_v t ON t.id = u.team_id AND t.org_id = u.org_id"""

ORACLE["team_members"] = with_views(USERS_V, TEAMS_V).rstrip().rstrip(",") + """
SELECT t.id AS team_id, u.id AS user_id, u.name, u.role AS org_role
FROM teams_v t JOIN users_v u ON u.team_id = t.id AND u.org_id = t.org_id"""

OWNERS = """owners AS (
  SELECT org_id, service, min(name) AS team
  FROM (SELECT org_id, name, unnest(services) AS service FROM teams_v) t GROUP BY org_id, service)"""

ORACLE["team_routing"] = with_views(CASES_V, TEAMS_V) + OWNERS + """
SELECT c.id, coalesce(o.team, 'Unassigned') AS team
FROM cases_v c LEFT JOIN owners o ON o.org_id = c.org_id AND o.service = c.primary_service"""

CASE_VIEW = OWNERS + f""",
view AS (
  SELECT c.id, c.org_id, c.primary_service, c.updated_at, printf('CASE-%04d', c.id) AS inc_id,
         coalesce(nullif(c.title, ''), c.primary_service || ' — investigating') AS title,
         coalesce(nullif(c.severity, ''), 'warning') AS severity,
         CASE WHEN c.status = 'RESOLVED' THEN 'resolved' ELSE 'open' END AS status,
         CASE WHEN nullif(c.primary_service, '') IS NOT NULL THEN c.primary_service ELSE '' END AS services,
         coalesce(o.team, 'Unassigned') AS team,
         coalesce(c.ai_summary, '') AS ai_summary, c.occurrence_count AS occurrences,
         {pyiso_sql('c.opened_at')} AS first_seen, {pyiso_sql('c.updated_at')} AS last_seen
  FROM cases_v c LEFT JOIN owners o ON o.org_id = c.org_id AND o.service = c.primary_service)"""
VIEW_COLS = "inc_id, title, severity, status, services, team, ai_summary, occurrences, first_seen, last_seen"

ORACLE["case_view"] = with_views(CASES_V, TEAMS_V) + CASE_VIEW + f"\nSELECT {VIEW_COLS} FROM view"

ORACLE["case_list"] = with_views(CASES_V, TEAMS_V) + CASE_VIEW + f"""
SELECT {VIEW_COLS} FROM view WHERE org_id = 'org-1' AND primary_service IN ('svc-1', 'svc-2')"""

ORACLE["case_detail"] = "WITH " + CASES_V + ",\n" + TEAMS_V + ",\n" + CASE_ACTIONS \
    + ",\n" + CASE_VIEW + ",\n" + CASE_REFS + f""",
req AS (SELECT ref, 'org-' || CAST(id % 3 AS VARCHAR) AS org_id,
               TRY_CAST(string_split(ref, '-')[-1] AS BIGINT) AS case_id FROM refs),
acts AS (
  SELECT ca.case_id, count(*) AS n_actions,
         arg_max(a.name, (CAST(ca.similarity_score AS DOUBLE), -ca.action_id)) AS top_action
  FROM case_actions ca JOIN {action_types_sql()} ON a.id = ca.action_id GROUP BY ca.case_id)
SELECT r.ref, v.inc_id, v.title, v.team, coalesce(x.n_actions, 0) AS n_actions, x.top_action
FROM req r JOIN view v ON v.id = r.case_id AND v.org_id = r.org_id LEFT JOIN acts x ON x.case_id = r.case_id""".replace(
    "AS actions(id, name, action_type)", "AS a(id, name, action_type)")

ORACLE["services_for_teams"] = with_views(TEAMS_V).rstrip().rstrip(",") + """
SELECT org_id, array_to_string(list_sort(list(DISTINCT service)), ',') AS services
FROM (SELECT org_id, unnest(services) AS service FROM teams_v) t GROUP BY org_id"""

ORACLE["org_overview"] = with_views(ORGS_V, TEAMS_V, USERS_V).rstrip().rstrip(",") + """
SELECT o.org_id, coalesce(t.n, 0) AS team_count, coalesce(u.n, 0) AS user_count
FROM orgs_v o LEFT JOIN (SELECT org_id, count(*) AS n FROM teams_v GROUP BY org_id) t USING (org_id)
LEFT JOIN (SELECT org_id, count(*) AS n FROM users_v GROUP BY org_id) u USING (org_id)"""

ORACLE["org_detail"] = with_views(ORGS_V, TEAMS_V, USERS_V).rstrip().rstrip(",") + """
SELECT o.org_id, t.teams, coalesce(u.n, 0) AS user_count, u.first_user
FROM orgs_v o
LEFT JOIN (SELECT org_id, string_agg(name, ',' ORDER BY name, id) AS teams FROM teams_v GROUP BY org_id) t
  USING (org_id)
LEFT JOIN (SELECT org_id, count(*) AS n, arg_min(name, (name, id)) AS first_user FROM users_v GROUP BY org_id) u
  USING (org_id)"""

ORACLE["org_entries"] = with_views(ORGS_V, TEAMS_V, USERS_V).rstrip().rstrip(",") + """
SELECT org_id, 'team' AS kind, id, name, CAST(NULL AS VARCHAR) AS role, array_to_string(services, ',') AS services
FROM teams_v WHERE org_id IN (SELECT org_id FROM orgs_v)
UNION ALL SELECT org_id, 'user', id, name, role, NULL FROM users_v WHERE org_id IN (SELECT org_id FROM orgs_v)"""

ORACLE["visible_cases"] = with_views(CASES_V, TEAMS_V, USERS_V) + """per_svc AS (
  SELECT org_id, primary_service AS service, count(*) AS n FROM cases_v GROUP BY ALL),
per_org AS (SELECT org_id, sum(n) AS org_n FROM per_svc GROUP BY org_id),
u AS (
  SELECT u.id AS user_id, u.org_id, u.role, coalesce(t.services, CAST([] AS VARCHAR[])) AS services
  FROM users_v u LEFT JOIN teams_v t ON t.id = u.team_id AND t.org_id = u.org_id)
SELECT user_id, CAST(sum(coalesce(p.n, 0)) AS BIGINT) AS n_visible
FROM (SELECT user_id, org_id, unnest(list_distinct(services)) AS service FROM u
      WHERE role <> 'org_admin' AND len(services) > 0) x
LEFT JOIN per_svc p USING (org_id, service) GROUP BY user_id
UNION ALL
SELECT user_id, CAST(coalesce(org_n, 0) AS BIGINT) FROM u LEFT JOIN per_org USING (org_id)
WHERE role = 'org_admin' OR len(services) = 0"""

ORACLE["service_overlap"] = with_views(TEAMS_V).rstrip().rstrip(",") + """
SELECT id, name FROM teams_v WHERE list_has_any(services, ['svc-1', 'svc-3'])"""

ORACLE["log_selector"] = with_views(LOG_LINES_V).rstrip().rstrip(",") + """
SELECT line_id, app FROM log_lines_v WHERE regexp_full_match(app, 'app-0|gateway') AND org_id = 'org-1'"""

ORACLE["log_line_contains"] = with_views(LOG_LINES_V).rstrip().rstrip(",") + """
SELECT line_id FROM log_lines_v WHERE contains(line, 'value=1')"""

ORACLE["log_line_regex"] = with_views(LOG_LINES_V).rstrip().rstrip(",") + """
SELECT line_id, app FROM log_lines_v WHERE regexp_matches(line, 'ERROR|CRITICAL')"""

RESOLVED_REQ = """ko AS (
  SELECT k.id AS key_id, k.key_hash, t.org_id AS key_org, k.revoked_at
  FROM ingest_keys_v k JOIN teams_v t ON t.id = k.team_id),
res AS (
  SELECT r.*, ko.key_id, ko.key_org,
         CASE WHEN r.api_key IS NULL THEN 'trusted' WHEN ko.key_id IS NULL THEN 'unknown'
              WHEN ko.revoked_at IS NOT NULL THEN 'revoked' ELSE 'accepted' END AS status
  FROM ingest_requests_v r LEFT JOIN ko ON ko.key_hash = sha256(r.api_key))"""

ORACLE["resolve_ingestion_keys"] = with_views(INGEST_REQUESTS_V, INGEST_KEYS_V, TEAMS_V) + RESOLVED_REQ + f"""
SELECT key_id, key_org AS org_id, count(*) AS n_requests, {iso('max(ts)')} AS last_used_at
FROM res WHERE status = 'accepted' GROUP BY key_id, key_org"""

ORACLE["rejected_ingestion"] = with_views(INGEST_REQUESTS_V, INGEST_KEYS_V, TEAMS_V) + RESOLVED_REQ + """
SELECT request_id, status AS reason FROM res WHERE status IN ('unknown', 'revoked')"""

ORACLE["assign_org"] = with_views(INGEST_REQUESTS_V, INGEST_KEYS_V, TEAMS_V) + RESOLVED_REQ + """
SELECT request_id, coalesce(CASE WHEN status = 'accepted' THEN key_org END, body_org, 'org-default') AS org_id
FROM res WHERE status IN ('trusted', 'accepted')"""

ORACLE["tenant_scope"] = with_views(INGEST_REQUESTS_V, INGEST_KEYS_V, TEAMS_V, LOGS_V) + RESOLVED_REQ + """,
sc AS (SELECT request_id, coalesce(CASE WHEN status = 'accepted' THEN key_org END, requested_org) AS read_org
       FROM res WHERE status IN ('trusted', 'accepted')),
per_org AS (SELECT org_id, count(*) AS n FROM logs_v GROUP BY org_id)
SELECT request_id, read_org,
       CAST(CASE WHEN read_org IS NULL THEN (SELECT sum(n) FROM per_org)
                 ELSE coalesce((SELECT n FROM per_org p WHERE p.org_id = sc.read_org), 0) END AS BIGINT)
         AS n_visible_logs
FROM sc"""

ROLLUP = """roll AS (
  SELECT org_id, trace_id, count(*) AS n_spans, count(*) FILTER (WHERE is_error) AS n_errors,
         sum(CAST(duration_ms AS DOUBLE)) AS total_ms,
         arg_min(service, (epoch_us(ts), id)) FILTER (WHERE is_error) AS first_error_service,
         arg_max(span_name, (duration_ms, -id)) AS slowest_span
  FROM traces_v GROUP BY org_id, trace_id)"""

ORACLE["trace_rollup"] = with_views(TRACES_V) + ROLLUP + """
SELECT org_id, trace_id, n_spans, n_errors, round(total_ms, 6) AS total_ms, first_error_service, slowest_span
FROM roll"""

ORACLE["log_span_join"] = with_views(TRACES_V, LOGS_V) + ROLLUP + """
SELECT l.id, l.trace_id, r.n_spans, r.n_errors, r.slowest_span
FROM logs_v l LEFT JOIN roll r ON r.org_id = l.org_id AND r.trace_id = l.trace_id"""

ORACLE["cascade_candidates"] = with_views(TRACES_V, CASES_V) + """e0 AS (
  SELECT org_id, service AS dst, lag(service) OVER (PARTITION BY org_id, trace_id ORDER BY ts, id) AS src
  FROM traces_v),
edges AS (SELECT org_id, src, dst, count(*) AS n_edges FROM e0 WHERE src IS NOT NULL AND src <> dst GROUP BY ALL),
oc AS (SELECT org_id, primary_service AS dst, count(*) AS dst_open_cases FROM cases_v
       WHERE status <> 'RESOLVED' GROUP BY ALL),
cand AS (SELECT * FROM edges JOIN oc USING (org_id, dst))
SELECT org_id, dst, src, n_edges, dst_open_cases,
       NOT EXISTS (SELECT 1 FROM cand c2 WHERE c2.org_id = cand.org_id AND c2.src = cand.dst) AS dst_is_root
FROM cand"""

ORACLE["declared_cascades"] = with_views(LOGS_V, TRACES_V, CASES_V) + """edges AS (
  SELECT org_id, service AS src, 'svc-' || ((CAST(substr(service, 5) AS INTEGER) + 1) % 5) AS dst, count(*) AS n_edges
  FROM (SELECT org_id, service FROM logs_v WHERE id % 4 = 0 UNION ALL SELECT org_id, service FROM traces_v WHERE id % 6 = 0) x
  GROUP BY ALL),
oc AS (SELECT org_id, primary_service AS dst, count(*) AS dst_open_cases FROM cases_v
       WHERE status <> 'RESOLVED' GROUP BY ALL),
cand AS (SELECT * FROM edges JOIN oc USING (org_id, dst))
SELECT org_id, dst, src, n_edges, dst_open_cases,
       NOT EXISTS (SELECT 1 FROM cand c2 WHERE c2.org_id = cand.org_id AND c2.src = cand.dst) AS dst_is_root
FROM cand"""

ORACLE["log_own_span"] = with_views(LOGS_V, TRACES_V) + """spans AS (
  SELECT org_id, trace_id, service, arg_min({'a': span_name, 'b': round(CAST(duration_ms AS DOUBLE), 6), 'c': is_error, 'd': error_code},
    (ts, id)) AS s FROM traces_v GROUP BY ALL)
SELECT l.id, CASE WHEN l.id % 5 <> 0 THEN l.trace_id END AS trace_id, l.service, s.a AS span_name, s.b AS duration_ms,
  s.c AS is_error, s.d AS error_code
FROM logs_v l LEFT JOIN spans x ON l.id % 5 <> 0 AND x.org_id = l.org_id AND x.trace_id = l.trace_id AND x.service = l.service"""

ORACLE["cofailure_pairs"] = with_views(TRACES_V) + """es AS (
  SELECT DISTINCT org_id, trace_id, service FROM traces_v WHERE is_error)
SELECT a.org_id, a.service AS service_a, b.service AS service_b, count(*) AS n_traces
FROM es a JOIN es b ON a.org_id = b.org_id AND a.trace_id = b.trace_id AND a.service < b.service
GROUP BY ALL"""

ORACLE["case_kpis"] = with_views(CASES_V).rstrip().rstrip(",") + """
SELECT org_id, count(*) FILTER (WHERE status <> 'RESOLVED') AS open,
       count(*) FILTER (WHERE status = 'RESOLVED') AS resolved,
       count(*) FILTER (WHERE occurrence_count > 1) AS recurring
FROM cases_v GROUP BY org_id"""

# ---------------------------------------------------------------- case state and context

from ..functions.catalog_data import actions_sql  # noqa: E402

GROUP_CTES = ",\n".join([BREACHES, GROUPED, SIGNATURES])
AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"

ORACLE["open_cases"] = with_views(METRICS_V, LOGS_V) + GROUP_CTES + f"""
SELECT org_id, service AS primary_service, {iso('first_ts')} AS opened_at, {iso('last_ts')} AS updated_at,
       'OPEN' AS status, 1 AS occurrence_count, severity, signature_text,
       strftime(last_ts, '%H:%M:%S') AS opened_time
FROM sig"""

ORACLE["recur_cases"] = with_views(CASES_V, ALERTS_V) + f"""m AS (
  SELECT case_id, count(*) AS n, arg_max(score, (rat, seq, score)) AS score, max(rat) AS at,
         bool_or(severity = 'critical') AS crit
  FROM (SELECT case_id, CAST((86 + CAST(quantity AS INTEGER) % 10) / 100.0 AS DECIMAL(5,4)) AS score,
               received_at AS rat, id AS seq, severity FROM alerts_v) x
  GROUP BY case_id)
SELECT c.id,
       CASE WHEN m.n IS NOT NULL AND c.status = 'RESOLVED' THEN 'INVESTIGATING' ELSE c.status END AS status,
       CAST(c.occurrence_count + coalesce(m.n, 0) AS INTEGER) AS occurrence_count,
       round(CAST(CASE WHEN m.n IS NOT NULL THEN m.score ELSE c.similarity_score END AS DOUBLE), 6) AS score,
       {iso('CASE WHEN m.n IS NOT NULL THEN m.at ELSE c.updated_at END')} AS updated_at,
       CASE WHEN coalesce(m.crit, false) THEN 'critical' ELSE c.severity END AS severity,
       {iso("CASE WHEN m.n IS NOT NULL AND c.status = 'RESOLVED' THEN NULL ELSE c.summarized_at END")}
         AS summarized_at,
       {iso("CASE WHEN m.n IS NOT NULL AND c.status = 'RESOLVED' THEN NULL ELSE c.matched_at END")} AS matched_at
FROM cases_v c LEFT JOIN m ON m.case_id = c.id"""

ROLLED = """rolled AS (
  SELECT arg_min(id, (triggered_at, id, received_at, severity)) AS id, case_id, service, metric,
         arg_min(severity, (triggered_at, id, received_at, severity)) AS severity, min(triggered_at) AS triggered_at,
         count(*) AS duplicate_count, arg_max(received_at, (triggered_at, id, received_at)) AS received_at
  FROM alerts_v GROUP BY case_id, service, metric)"""

ORACLE["alert_rollup"] = with_views(ALERTS_V) + ROLLED + f"""
SELECT id, case_id, service, metric, severity, {iso('triggered_at')} AS triggered_at,
       CAST(duplicate_count AS INTEGER) AS duplicate_count, {iso('received_at')} AS received_at
FROM rolled"""

ORACLE["alert_rollup_update"] = with_views(ALERTS_V) + f"""halves AS (
  SELECT *, triggered_at >= TIMESTAMP '1996-01-01' AS h, 'org-' || (case_id % 3) AS org_id,
    '{{"q":' || CAST(quantity AS INTEGER) || '}}' AS raw_payload FROM alerts_v)
SELECT arg_min(id, (triggered_at, id, received_at, severity, raw_payload)) AS id, any_value(org_id) AS org_id, case_id,
  service, metric, arg_min(severity, (triggered_at, id, received_at, severity, raw_payload)) AS severity,
  arg_min(raw_payload, (triggered_at, id, received_at, severity, raw_payload)) AS raw_payload,
  {iso('min(triggered_at)')} AS triggered_at, CAST(count(*) AS INTEGER) AS duplicate_count,
  {iso('arg_max(received_at, (triggered_at, id, received_at))')} AS received_at
FROM halves GROUP BY case_id, service, metric"""

ORACLE["case_timeline"] = with_views(ALERTS_V) + ROLLED + """,
e AS (SELECT case_id, triggered_at, id, service, metric, strftime(triggered_at, '%H:%M:%S') AS time,
             'Alert ' || metric || ' on ' || service || ' (' || severity || ')' AS event FROM rolled)
SELECT case_id, CAST(count(*) AS INTEGER) AS n_entries,
       arg_min(event, (triggered_at, id, service, metric)) AS first_event,
       string_agg(time || ' ' || event, '; ' ORDER BY triggered_at, id, service, metric) AS timeline_text
FROM e GROUP BY case_id"""

ORACLE["save_summaries"] = with_views(CASES_V) + MODEL_OUTPUTS + f"""
SELECT c.id,
       CASE WHEN json_valid(m.t) THEN json_extract_string(m.t, '$.title') ELSE c.title END AS title,
       CASE WHEN json_valid(m.t) THEN json_extract_string(m.t, '$.ai_summary') ELSE c.ai_summary END AS ai_summary,
       coalesce(json_valid(m.t), false) AS summarized,
       CASE WHEN json_valid(m.t) THEN {iso(AS_OF)} END AS summarized_at
FROM cases_v c LEFT JOIN cleaned m ON m.case_id = c.id
WHERE c.summarized_at IS NULL"""

ORACLE["resolved_timeline"] = with_views(CASES_V, ALERTS_V) + f"""cmds AS (
  SELECT case_id, 'org-' || CAST(id % 3 AS VARCHAR) AS org_id, received_at FROM alerts_v WHERE metric = 'R')
SELECT m.case_id, m.org_id, {iso('m.received_at')} AS "at", strftime(m.received_at, '%H:%M:%S') AS time,
       'Case resolved' AS event, '#34d399' AS color
FROM cmds m JOIN cases_v c ON c.id = m.case_id AND c.org_id = m.org_id"""

ORACLE["case_view_timeline"] = with_views(CASES_V, TEAMS_V, ALERTS_V) + CASE_VIEW + """,
cmds AS (SELECT case_id, 'org-' || CAST(id % 3 AS VARCHAR) AS org_id, received_at FROM alerts_v WHERE metric = 'R')
SELECT v.inc_id, v.team, 0 AS n_evidence, 0 AS n_cascades,
  CAST(row_number() OVER (PARTITION BY v.id ORDER BY m.received_at) - 1 AS INTEGER) AS pos,
  strftime(m.received_at, '%H:%M:%S') AS time, 'Case resolved' AS event, '#34d399' AS color
FROM cmds m JOIN view v ON v.id = m.case_id AND v.org_id = m.org_id"""

ORACLE["resolve_cases"] = with_views(CASES_V, ALERTS_V) + f"""agg AS (
  SELECT case_id, 'org-' || CAST(id % 3 AS VARCHAR) AS org_id, max(received_at) AS at, count(*) AS n
  FROM alerts_v WHERE metric = 'R' GROUP BY ALL)
SELECT c.id, 'RESOLVED' AS status, {iso('a.at')} AS updated_at, a.n AS resolve_commands
FROM cases_v c JOIN agg a ON a.case_id = c.id AND a.org_id = c.org_id"""

ORACLE["apply_actions"] = "WITH " + CASES_V + ",\n" + CASE_ACTIONS + f""",
cmds AS (SELECT DISTINCT case_id, 'org-' || CAST(case_id % 3 AS VARCHAR) AS org_id,
                CAST(case_id % 10 + 1 AS INTEGER) AS action_id FROM case_actions),
sugg AS (SELECT DISTINCT case_id, action_id FROM case_actions),
j AS (
  SELECT x.case_id, x.action_id, c.id AS cid, c.status, s.case_id AS sid, a.action_type
  FROM cmds x LEFT JOIN cases_v c ON c.id = x.case_id AND c.org_id = x.org_id
  LEFT JOIN sugg s ON s.case_id = x.case_id AND s.action_id = x.action_id
  LEFT JOIN {actions_sql()} ON a.id = x.action_id)
SELECT case_id, action_id,
       CASE WHEN cid IS NULL THEN 'not_found' WHEN sid IS NULL THEN 'not_suggested' ELSE 'applied' END AS outcome,
       action_type,
       CASE WHEN cid IS NULL OR sid IS NULL THEN status WHEN action_type = 'raise_pr' THEN status
            ELSE 'RESOLVED' END AS new_status
FROM j"""

APPLIED = "WITH " + CASES_V + ",\n" + CASE_ACTIONS + f""",
done AS (SELECT x.case_id, x.action_id, a.action_type, a.name, CAST({AS_OF} AS TIMESTAMP) + to_seconds(x.action_id) AS at,
    CASE WHEN a.action_type = 'raise_pr' THEN '{{"pr_url":"https://example.org/pr/' || x.case_id || '"}}'
         ELSE '{{"simulated":true,"note":"Simulated ''' || a.action_type || ''': ' || a.name || '"}}' END AS result
  FROM (SELECT DISTINCT case_id, action_id FROM case_actions WHERE case_id % 2 = 0) x
  JOIN cases_v c ON c.id = x.case_id AND c.org_id = 'org-' || CAST(x.case_id % 4 AS VARCHAR)
  LEFT JOIN {actions_sql()} ON a.id = x.action_id)"""

ORACLE["applied_case_actions"] = APPLIED + f"""
SELECT s.case_id, s.action_id, CASE WHEN d.case_id IS NULL THEN 'suggested' ELSE 'applied' END AS status,
  CASE WHEN d.case_id IS NOT NULL THEN 'u' || s.action_id END AS applied_by, {iso('d.at')} AS applied_at, d.result
FROM case_actions s LEFT JOIN done d ON d.case_id = s.case_id AND d.action_id = s.action_id"""

ORACLE["case_detail_actions"] = APPLIED + ",\n" + CASE_REFS + f""",
req AS (SELECT ref, 'org-' || CAST(id % 3 AS VARCHAR) AS org_id,
               TRY_CAST(string_split(ref, '-')[-1] AS BIGINT) AS case_id FROM refs)
SELECT r.ref, CAST(row_number() OVER (PARTITION BY r.ref ORDER BY s.similarity_score DESC NULLS LAST, s.action_id) - 1 AS INTEGER) AS pos,
  s.action_id, a.name, a.action_type, a.description, round(CAST(s.similarity_score AS DOUBLE), 6) AS score,
  CASE WHEN d.case_id IS NULL THEN 'suggested' ELSE 'applied' END AS status,
  CASE WHEN d.case_id IS NOT NULL THEN 'u' || s.action_id END AS applied_by, {iso('d.at')} AS applied_at, d.result
FROM req r JOIN cases_v c ON c.id = r.case_id AND c.org_id = r.org_id JOIN case_actions s ON s.case_id = r.case_id
JOIN {actions_sql()} ON a.id = s.action_id
LEFT JOIN done d ON d.case_id = s.case_id AND d.action_id = s.action_id"""

ORACLE["applied_cases"] = APPLIED + f"""
SELECT c.id, CASE WHEN bool_or(coalesce(d.action_type <> 'raise_pr', d.case_id IS NOT NULL)) THEN 'RESOLVED' ELSE c.status END AS status,
  {iso('coalesce(max(d.at), c.updated_at)')} AS updated_at
FROM cases_v c LEFT JOIN done d ON d.case_id = c.id GROUP BY c.id, c.status, c.updated_at"""

ORACLE["applied_timeline"] = APPLIED + """
SELECT case_id, action_id, 0 AS pos, CASE WHEN action_type = 'raise_pr'
  THEN 'PR opened: https://example.org/pr/' || case_id || ' — awaiting merge' ELSE 'Applied: ' || name END AS event, '#60a5fa' AS color FROM done
UNION ALL SELECT case_id, action_id, 1, 'Case resolved', '#34d399' FROM done WHERE action_type <> 'raise_pr'"""

ORACLE["work_queues"] = with_views(CASES_V).rstrip().rstrip(",") + """
SELECT id, CASE WHEN summarized_at IS NULL THEN 'summarize' WHEN matched_at IS NULL THEN 'match' ELSE 'done' END
         AS queue
FROM cases_v"""

ORACLE["case_context_logs"] = with_views(METRICS_V, LOGS_V) + GROUP_CTES + f"""
SELECT c.org_id, c.service, {iso('c.first_ts')} AS opened_at, l.id AS log_id, {iso('l.ts')} AS ts
FROM sig c JOIN logs_v l ON l.org_id = c.org_id AND l.service = c.service
 AND l.ts BETWEEN c.first_ts - INTERVAL 30 SECOND AND c.last_ts + INTERVAL 30 SECOND"""

ORACLE["case_context_alerts"] = with_views(CASES_V, ALERTS_V).rstrip().rstrip(",") + f"""
SELECT case_id, id, {iso('triggered_at')} AS triggered_at, metric, severity
FROM alerts_v WHERE case_id IN (SELECT id FROM cases_v)"""

ORACLE["recurrence_candidates"] = with_views(METRICS_V, LOGS_V) + GROUP_CTES + f"""
SELECT g.org_id, g.service, {iso('g.first_ts')} AS first_ts, {iso('c.first_ts')} AS cand_opened_at
FROM sig g JOIN sig c ON c.org_id = g.org_id AND c.service = g.service
 AND c.last_ts >= g.first_ts - INTERVAL 6 HOUR AND c.last_ts < g.first_ts"""

ORACLE["case_prompt"] = with_views(METRICS_V, LOGS_V) + GROUP_CTES + f""",
ca AS (
  SELECT org_id, service, gs, metric, arg_min(severity, (ts, src_id * 16 + seq * 3 + sub)) AS severity,
         min(ts) AS triggered_at, min_by(src_id * 16 + seq * 3 + sub, (ts, src_id * 16 + seq * 3 + sub)) AS fid,
         count(*) AS n
  FROM grouped GROUP BY org_id, service, gs, metric),
al AS (
  SELECT org_id, service, gs, count(*) AS n_alerts,
         string_agg(printf('- [%s] %s on %s at %s seen %dx', severity, metric, service,
                           strftime(triggered_at, '%Y-%m-%d %H:%M:%S'), n), chr(10) ORDER BY triggered_at, fid) AS txt
  FROM ca GROUP BY org_id, service, gs),
lg AS (
  SELECT c.org_id, c.service, c.gs, count(*) AS n_logs,
         string_agg(printf('[%s] [%s] [%s] %s', strftime(l.ts, '%Y-%m-%d %H:%M:%S'), l.level, l.event, l.message),
                    chr(10) ORDER BY l.ts, l.id) AS txt
  FROM sig c JOIN logs_v l ON l.org_id = c.org_id AND l.service = c.service
   AND l.ts BETWEEN c.first_ts - INTERVAL 30 SECOND AND c.last_ts + INTERVAL 30 SECOND
  GROUP BY c.org_id, c.service, c.gs)
SELECT s.org_id, s.service AS primary_service, {iso('s.first_ts')} AS opened_at,
       CAST(coalesce(a.n_alerts, 0) AS INTEGER) AS n_alerts, CAST(coalesce(g.n_logs, 0) AS INTEGER) AS n_logs,
       'CASE' || chr(10) || 'service=' || s.service || ' | status=OPEN | occurrence_count=1' || chr(10)
         || 'signature: ' || s.signature_text || chr(10) || chr(10) || 'ALERTS' || chr(10)
         || coalesce(nullif(a.txt, ''), 'none') || chr(10) || chr(10) || 'LOGS' || chr(10)
         || coalesce(nullif(g.txt, ''), 'none') AS prompt
FROM sig s LEFT JOIN al a USING (org_id, service, gs) LEFT JOIN lg g USING (org_id, service, gs)"""

def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SENT_TASK = ("Summarize the case below for the engineer on call. Its breaches are grouped already and the decision whether it "
             "recurred is made: do not decide it again. Give a title, root causes ranked by likelihood, the evidence for "
             "them, and what to do next.\n\nCASE\n")
SENT_ANSWER = """\n\nANSWER with this JSON alone, without markdown
{"title": "at most 8 words",
 "hypotheses": [{"rank": 1, "text": "root cause", "confidence": 0-100}],
 "evidence": [{"type": "log|metric|pattern", "label": "source", "text": "detail"}],
 "ai_summary": "2 sentences: what happened, next step"}"""

ORACLE["summary_prompts"] = with_views(CASES_V, ALERTS_V, LOGS_V) + f"""waiting AS (SELECT * FROM cases_v WHERE summarized_at IS NULL),
paid AS (SELECT a.*, '{{"q":' || CAST(a.quantity AS INTEGER) || '}}' AS raw_payload FROM alerts_v a
         WHERE a.case_id IN (SELECT id FROM waiting)),
rolled AS (
  SELECT case_id, service, metric, min(triggered_at) AS triggered_at, count(*) AS n,
    arg_min({{'id': id, 'severity': severity, 'raw_payload': raw_payload}}, (triggered_at, id, received_at, severity, raw_payload)) AS f
  FROM paid GROUP BY case_id, service, metric),
al AS (
  SELECT case_id, count(*) AS n, string_agg(printf('- [%s] %s on %s at %s seen %dx | %s', f.severity, metric, service,
    strftime(triggered_at, '%Y-%m-%d %H:%M:%S'), n, f.raw_payload), chr(10) ORDER BY triggered_at, f.id,
    printf('- [%s] %s on %s', f.severity, metric, service)) AS t
  FROM rolled GROUP BY case_id),
lg AS (
  SELECT c.id AS case_id, count(*) AS n, string_agg(printf('[%s] [%s] [%s] %s', strftime(l.ts, '%Y-%m-%d %H:%M:%S'), l.level, l.event,
    l.message), chr(10) ORDER BY l.ts, l.id) AS t
  FROM waiting c JOIN logs_v l ON l.org_id = c.org_id AND l.service = c.primary_service
   AND l.ts BETWEEN c.opened_at - INTERVAL 30 SECOND AND c.updated_at + INTERVAL 30 SECOND GROUP BY c.id)
SELECT c.id AS case_id, {_text(SENT_TASK)} || 'service=' || c.primary_service || ' | status=' || c.status || ' | occurrence_count='
    || c.occurrence_count || chr(10) || 'signature: ' || coalesce(c.signature_text, '') || chr(10) || chr(10) || 'ALERTS' || chr(10)
    || coalesce(al.t, 'none') || chr(10) || chr(10) || 'LOGS' || chr(10) || coalesce(lg.t, 'none') || {_text(SENT_ANSWER)} AS prompt,
  CAST(coalesce(al.n, 0) AS INTEGER) AS n_alerts, CAST(coalesce(lg.n, 0) AS INTEGER) AS n_logs
FROM waiting c LEFT JOIN al ON al.case_id = c.id LEFT JOIN lg ON lg.case_id = c.id"""

ORACLE["upload_context"] = with_views(CASES_V, LOG_FILES_V) + """top AS (
  SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY updated_at DESC NULLS FIRST, id DESC) AS rn
  FROM cases_v WHERE status <> 'RESOLVED'),
inc AS (
  SELECT org_id, string_agg('- ' || printf('CASE-%04d', id) || ': ' || coalesce(title, 'None') || ' | '
                            || coalesce(severity, 'None') || ' | ' || coalesce(ai_summary, 'None'),
                            chr(10) ORDER BY rn) AS lines
  FROM top WHERE rn <= 20 GROUP BY org_id),
docs AS (SELECT doc_id, line AS text, 'org-' || CAST(doc_id % 3 AS VARCHAR) AS org_id FROM log_files_v),
ctx AS (
  SELECT d.doc_id, d.org_id,
         'RAW LOG TEXT (unparsed):' || chr(10) || d.text || chr(10) || chr(10)
         || CASE WHEN i.lines IS NOT NULL THEN 'CURRENTLY OPEN INCIDENTS:' || chr(10) || i.lines
                 ELSE 'CURRENTLY OPEN INCIDENTS: none' END AS c
  FROM docs d LEFT JOIN inc i USING (org_id))
SELECT doc_id, org_id, CAST(length(c) AS INTEGER) AS n_chars, sha256(c) AS context_sha256 FROM ctx"""

ORACLE["remediation_notes"] = "WITH " + CASES_V + ",\n" + CASE_ACTIONS + ",\n" + MODEL_OUTPUTS.replace(
    "mo AS (", "mo AS (", 1) + f""",
top AS (
  SELECT ca.case_id, arg_min(a.name, (-ca.similarity_score, ca.action_id)) AS name,
         arg_min(a.description, (-ca.similarity_score, ca.action_id)) AS description
  FROM case_actions ca JOIN {actions_sql()} ON a.id = ca.action_id GROUP BY ca.case_id),
hyp AS (
  SELECT case_id,
         CASE WHEN json_valid(t) THEN array_to_string(list_transform(
              CAST(json_extract(t, '$.hypotheses') AS JSON[]),
              lambda h: '- (' || coalesce(json_extract_string(h, '$.confidence'), 'None') || '%) '
                   || coalesce(json_extract_string(h, '$.text'), 'None')), chr(10)) ELSE '' END AS lines
  FROM cleaned)
SELECT c.id AS case_id,
       '# Remediation for ' || coalesce(c.primary_service, 'None') || ' — Case #' || CAST(c.id AS VARCHAR)
       || chr(10) || chr(10) || '**Title:** ' || coalesce(nullif(c.title, ''), 'Untitled case')
       || chr(10) || chr(10) || '**AI summary:** ' || coalesce(nullif(c.ai_summary, ''), 'n/a')
       || chr(10) || chr(10) || '**Suggested action:** ' || t.name || ' — ' || t.description
       || chr(10) || chr(10) || '**Hypotheses:**' || chr(10) || coalesce(h.lines, '') AS note
FROM cases_v c JOIN top t ON t.case_id = c.id LEFT JOIN hyp h ON h.case_id = c.id"""

# ---------------------------------------------------------------- ingest


def _numbered_sql(view: str, ts: str = "ts") -> str:
    return f"""r AS (
  SELECT *, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY org_id, CAST(ts AS DATE)
    ORDER BY date_trunc('hour', ts), id) - 1 AS seq FROM {view}),
b AS (SELECT *, seq // 40 AS body_no, seq % 40 AS pos, max(ts) OVER (PARTITION BY org_id, d, seq // 40) AS rts,
  count(*) OVER (PARTITION BY org_id, d, seq // 40) AS body_rows FROM r)"""


def _ingest_sql(view: str, cols: str) -> str:
    return _numbered_sql(view) + f"""
SELECT org_id AS batch_user, CAST(d AS VARCHAR) AS batch_day, body_no, pos, {cols}, {iso('rts')} AS ts
FROM b"""


ORACLE["ingest_logs"] = with_views(LOGS_V) + _ingest_sql(
    "logs_v", "service, level, event, trace_id, message, 'k=' || json_extract_string(context, '$.k') AS context, "
              "org_id")
ORACLE["ingest_traces"] = with_views(TRACES_V) + _ingest_sql(
    "traces_v", "trace_id, service, span_name, round(CAST(duration_ms AS DOUBLE), 6) AS duration_ms, is_error, "
                "error_code")
ORACLE["ingest_metrics"] = with_views(METRICS_V) + _ingest_sql(
    "metrics_v", "service, round(CAST(error_rate AS DOUBLE), 6) AS error_rate, "
                 "round(CAST(p99_latency_ms AS DOUBLE), 6) AS p99_latency_ms, active_connections, "
                 "round(CAST(rss_mb AS DOUBLE), 6) AS rss_mb")

ORACLE["ingest_alerts"] = with_views(ALERTS_V) + f"""r AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY floor(epoch_us(triggered_at) / (400 * 86400000000.0)), id,
    case_id, source_tool, service, metric, severity, triggered_at) - 1 AS seq FROM alerts_v)
SELECT case_id AS batch_case, seq // 3 AS body_no, seq % 3 AS pos, service, metric, severity,
       {iso('triggered_at')} AS triggered_at, 1 AS duplicate_count,
       {iso('max(received_at) OVER (PARTITION BY case_id, seq // 3)')} AS received_at
FROM r"""

ORACLE["ingest_cases"] = with_views(CASES_V) + f"""r AS (
  SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY floor(epoch_us(opened_at) / (7 * 86400000000.0)), id) - 1 AS seq
  FROM cases_v)
SELECT org_id AS batch_org, seq // 40 AS body_no, seq % 40 AS pos, status, primary_service,
  {iso('opened_at')} AS opened_at, signature_text, round(CAST(similarity_score AS DOUBLE), 6) AS score,
  CASE WHEN id % 2 = 0 THEN occurrence_count ELSE 1 END AS occurrence_count, severity,
  CASE WHEN id % 3 > 0 THEN org_id ELSE 'org-default' END AS org_id FROM r"""

ORACLE["ingest_refused"] = with_views(METRICS_V) + _numbered_sql("metrics_v") + """,
bodies AS (SELECT org_id, d, body_no, any_value(body_rows) AS n FROM b GROUP BY ALL)
SELECT org_id AS batch_user, CAST(d AS VARCHAR) AS batch_day, body_no,
  CASE WHEN body_no % 7 = 2 THEN 'unparseable' WHEN n > 35 THEN 'too_many_rows' ELSE 'missing_field' END AS reason,
  CASE WHEN body_no % 7 = 2 THEN NULL ELSE n END AS n_rows
FROM bodies WHERE body_no % 7 IN (1, 2) OR n > 35"""

ORACLE["ingest_batch_guard"] = """
SELECT user_id AS batch_user, CAST(CAST(ts AS DATE) AS VARCHAR) AS batch_day, count(*) AS n_rows,
       count(*) <= 3 AS accepted
FROM events GROUP BY ALL"""

ORACLE["incremental_scan"] = with_views(METRICS_V, LOGS_V) + f"""cp AS (SELECT TIMESTAMP '2024-01-29 00:00:00' AS t)
SELECT 'metrics' AS src, id, {iso('ts')} AS ts FROM metrics_v, cp WHERE ts > cp.t
UNION ALL
SELECT 'logs', id, {iso('ts')} FROM logs_v, cp WHERE ts > cp.t"""

ORACLE["high_water_mark"] = with_views(METRICS_V, LOGS_V).rstrip().rstrip(",") + f"""
SELECT {iso('greatest((SELECT max(ts) FROM metrics_v), (SELECT max(ts) FROM logs_v))')} AS max_ts"""

# ---------------------------------------------------------------- cooldown and streams

COOLDOWN_SQL = f"""WITH RECURSIVE items AS (
  SELECT 'org-' || CAST(user_id % 3 AS VARCHAR) AS org_id, 'svc-' || CAST(user_id % 5 AS VARCHAR) AS service, event_type AS alert, epoch_us(ts) AS us,
         event_id AS id
  FROM events),
nx AS (
  SELECT *, min(us) OVER (PARTITION BY org_id, service, alert ORDER BY us
                          RANGE BETWEEN 21600000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS n_us
  FROM items),
nx2 AS (
  SELECT nx.org_id, nx.service, nx.alert, nx.us, nx.id, nx.n_us, m.n_id
  FROM nx LEFT JOIN (SELECT org_id, service, alert, us, min(id) AS n_id FROM items GROUP BY ALL) m
    ON m.org_id = nx.org_id AND m.service = nx.service AND m.alert = nx.alert AND m.us = nx.n_us),
heads AS (
  SELECT org_id, service, alert, us, id FROM (
    SELECT *, row_number() OVER (PARTITION BY org_id, service, alert ORDER BY us, id) AS rn FROM items) t WHERE rn = 1),
chain(org_id, service, alert, us, id) AS (
  SELECT org_id, service, alert, us, id FROM heads
  UNION ALL
  SELECT n.org_id, n.service, n.alert, n.n_us, n.n_id FROM chain c
  JOIN nx2 n ON n.org_id = c.org_id AND n.service = c.service AND n.alert = c.alert AND n.us = c.us AND n.id = c.id
  WHERE n.n_us IS NOT NULL)
SELECT org_id, service, alert, id, {iso('make_timestamp(us)')} AS ts FROM chain"""

ORACLE["alert_cooldown"] = COOLDOWN_SQL
ORACLE["stream_cooldown"] = COOLDOWN_SQL

STREAM_BREACHES = MB + ",\n" + LB + """,
breaches AS (SELECT * FROM mb UNION ALL SELECT * FROM lb)"""

ORACLE["stream_detect"] = ORACLE["all_breaches"]  # a stream finds what the batch finds, the trend included

ORACLE["stream_breach_sessions"] = with_views(METRICS_V, LOGS_V) + STREAM_BREACHES + ",\n" + GROUPED + f"""
SELECT org_id, service, {iso('min(ts)')} AS first_ts, {iso('max(ts)')} AS last_ts, count(*) AS n_breaches,
       CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END AS severity,
       array_to_string(list_sort(list_distinct(list(metric))), ',') AS metrics
FROM grouped GROUP BY org_id, service, gs"""

# ---------------------------------------------------------------- files, incidents, context fetch

DOC_LINES = """
SELECT source AS filename, {extra} unnest(string_split(text, chr(10))) AS line FROM documents"""

ORACLE["tail_log_files"] = DOC_LINES.format(extra="'varlogs' AS job,")
ORACLE["load_log_uploads"] = DOC_LINES.format(extra="false AS refused,")

INCIDENTS = """inc AS (
  SELECT org_id, coalesce(alertname, 'alert') AS title,
         arg_min(CASE WHEN regexp_matches(coalesce(alertname, ''), 'ERROR|CRITICAL') THEN 'critical'
                      ELSE 'warning' END, (ts, env_id)) AS severity,
         count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen,
         arg_min(env_id, (ts, env_id)) AS first_env
  FROM hdr GROUP BY org_id, coalesce(alertname, 'alert')),
numbered AS (
  SELECT *, printf('INC-%04d', row_number() OVER (ORDER BY first_seen, first_env, org_id, title)) AS inc_id
  FROM inc)"""

ORACLE["incident_upsert"] = with_views(LOG_LINES_V, ENVELOPES_V) + ALERTS_SQL + ",\n" + INCIDENTS + f"""
SELECT inc_id, org_id, title, severity, CAST(occurrences AS INTEGER) AS occurrences,
       {iso('first_seen')} AS first_seen, {iso('last_seen')} AS last_seen, 'open' AS status
FROM numbered"""

INCIDENT_BATCH = INCIDENTS.replace("FROM hdr GROUP", "FROM hdr WHERE ts < TIMESTAMP '2024-01-16' GROUP") + """,
old AS (SELECT inc_id, org_id, title, CASE WHEN inc_id >= 'INC-0004' THEN 'resolved' ELSE 'open' END AS status,
  CAST(occurrences AS BIGINT) AS occurrences, first_seen, last_seen FROM numbered),
base AS (SELECT * FROM old UNION ALL SELECT 'INC-00' || substr(inc_id, 5, 4), org_id, title, 'open', occurrences, first_seen,
  last_seen FROM old WHERE inc_id <= 'INC-0002'),
a0 AS (SELECT env_id AS seq, org_id, ts, service, coalesce(app, 'Unknown') AS team,
  coalesce(alertname, 'alert') || CASE WHEN env_id % 5 = 0 THEN ' #' || (env_id % 40) ELSE '' END AS title,
  CASE WHEN env_id % 11 = 0 THEN 'INC-0002' WHEN env_id % 13 = 0 THEN 'INC-9999' END AS dup,
  CASE WHEN env_id % 7 = 0 AND env_id % 14 <> 0 THEN 'INC-0001' END AS root FROM hdr WHERE ts >= TIMESTAMP '2024-01-16'),
a1 AS (SELECT a.*, (SELECT min(b.inc_id) FROM base b WHERE b.org_id = a.org_id AND b.title = a.title AND b.status = 'open') AS open_id,
  EXISTS (SELECT 1 FROM base b WHERE b.org_id = a.org_id AND b.inc_id = a.dup) AS dup_known,
  EXISTS (SELECT 1 FROM base b WHERE b.org_id = a.org_id AND b.inc_id = a.root) AS root_known FROM a0 a),
made AS (SELECT *, printf('INC-%04d', (SELECT count(*) FROM base) + row_number() OVER (ORDER BY ts, seq, org_id, title)) AS made_id
  FROM (SELECT org_id, title, min((ts, seq)) AS at, min(ts) AS ts, arg_min(seq, (ts, seq)) AS seq FROM a1
        WHERE dup IS NULL AND open_id IS NULL AND NOT root_known GROUP BY org_id, title) m),
decided AS (SELECT a.*, CASE WHEN dup IS NOT NULL THEN CASE WHEN dup_known THEN 'updated' ELSE 'ignored' END
    WHEN open_id IS NOT NULL OR (m.ts, m.seq) < (a.ts, a.seq) THEN 'updated' WHEN root_known THEN 'cascade' ELSE 'created' END AS action,
  m.made_id FROM a1 a LEFT JOIN made m ON m.org_id = a.org_id AND m.title = a.title),
targeted AS (SELECT *, CASE action WHEN 'ignored' THEN NULL WHEN 'cascade' THEN root WHEN 'created' THEN made_id
  ELSE coalesce(dup, open_id, made_id) END AS target FROM decided)"""

ORACLE["incident_decisions"] = with_views(LOG_LINES_V, ENVELOPES_V) + ALERTS_SQL + ",\n" + INCIDENT_BATCH + """
SELECT seq, org_id, title, action, target FROM targeted"""

ORACLE["incident_next_state"] = with_views(LOG_LINES_V, ENVELOPES_V) + ALERTS_SQL + ",\n" + INCIDENT_BATCH + f""",
every AS (SELECT inc_id, org_id, title, status, occurrences, first_seen, last_seen FROM base
  UNION ALL SELECT made_id, org_id, title, 'open', 1, ts, ts FROM made),
hits AS (SELECT org_id, target, count(*) FILTER (WHERE action = 'updated') AS n, count(*) FILTER (WHERE action = 'cascade') AS c,
  max(ts) AS ts FROM targeted WHERE action IN ('updated', 'cascade') GROUP BY ALL)
SELECT e.inc_id, e.org_id, e.title, e.status, CAST(e.occurrences + coalesce(h.n, 0) AS INTEGER) AS occurrences,
  CAST(coalesce(h.c, 0) AS INTEGER) AS n_cascades, {iso('e.first_seen')} AS first_seen,
  {iso('greatest(e.last_seen, coalesce(h.ts, e.last_seen))')} AS last_seen
FROM every e LEFT JOIN hits h ON h.org_id = e.org_id AND h.target = e.inc_id"""

ORACLE["incident_timeline"] = with_views(LOG_LINES_V, ENVELOPES_V) + ALERTS_SQL + ",\n" + INCIDENT_BATCH + """,
entries AS (SELECT *, unnest(CASE action WHEN 'updated' THEN [{'p': 0, 'event': 'Occurred again', 'color': '#fbbf24'}]
  WHEN 'cascade' THEN [{'p': 0, 'event': 'Cascade: ' || coalesce(CASE WHEN seq % 4 <> 0 THEN service END, '?') || ' — slow',
    'color': '#fb923c'}]
  WHEN 'created' THEN [{'p': 0, 'event': 'Logs analyzed by AI agent', 'color': '#818cf8'},
    {'p': 1, 'event': 'Root cause hypotheses generated', 'color': '#a78bfa'},
    {'p': 2, 'event': 'Supporting evidence collected', 'color': '#34d399'},
    {'p': 3, 'event': 'Routed to ' || team, 'color': '#60a5fa'}] END) AS e FROM targeted)
SELECT seq, org_id, target AS inc_id, e.p AS pos, strftime(ts, '%H:%M:%S') AS time, e.event AS event, e.color AS color FROM entries"""

ORACLE["open_incidents"] = with_views(LOG_LINES_V, ENVELOPES_V) + ALERTS_SQL + ",\n" + INCIDENTS + """
SELECT org_id, inc_id, title, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY last_seen DESC NULLS FIRST, inc_id DESC) AS rn
  FROM numbered) t WHERE rn <= 20"""

ORACLE["incidents_of_services"] = with_views(LOG_LINES_V, ENVELOPES_V) + ALERTS_SQL + ",\n" + INCIDENTS.replace(
    "count(*) AS occurrences", "arg_min(coalesce(service, ''), (ts, env_id)) AS service, count(*) AS occurrences") + f"""
SELECT inc_id, title, severity, service AS services, {iso('last_seen')} AS last_seen
FROM numbered WHERE org_id = 'org-1' AND service IN ('svc-1', 'svc-3')"""

ORACLE["fetch_context_logs"] = with_views(LOG_LINES_V, ENVELOPES_V) + ALERTS_SQL + """,
lines AS (
  SELECT h.env_id, h.alertname, unnest(CAST(json_extract(e.payload, '$.context.logs') AS VARCHAR[])) AS line,
         generate_subscripts(CAST(json_extract(e.payload, '$.context.logs') AS VARCHAR[]), 1) - 1 AS pos
  FROM hdr h JOIN envelopes_v e USING (env_id)),
""" + parse_lines_sql("lines", "env_id, pos") + """,
req AS (
  SELECT h.env_id AS req_id, h.org_id, h.ts AS as_of, CASE WHEN h.env_id % 3 <> 0 THEN h.service END AS service,
    CASE WHEN h.env_id % 6 <> 0 THEN c.trace_id END AS trace_id
  FROM hdr h LEFT JOIN (SELECT p.env_id, c.trace_id FROM parsed p JOIN ctxtext c USING (env_id, pos)
                        WHERE p.pos = 0) c ON c.env_id = h.env_id),
lk AS (
  SELECT line_id, org_id, ts, line FROM log_lines_v),
bt AS (
  SELECT r.req_id, l.line_id, l.ts, 'trace' AS branch FROM req r JOIN lk l
    ON l.org_id = r.org_id AND r.trace_id <> '' AND contains(l.line, 'trace_id=' || r.trace_id) AND l.ts BETWEEN r.as_of - INTERVAL 90 SECOND AND r.as_of),
bs AS (
  SELECT r.req_id, l.line_id, l.ts, CASE WHEN coalesce(r.service, '') = '' THEN 'level' ELSE 'service' END AS branch
  FROM req r JOIN lk l
    ON l.org_id = r.org_id AND (coalesce(r.service, '') = '' OR contains(l.line, r.service))
   AND regexp_matches(l.line, 'ERROR|CRITICAL|WARN')
   AND l.ts BETWEEN r.as_of - (CASE WHEN coalesce(r.trace_id, '') <> '' THEN INTERVAL 90 SECOND
                                    ELSE INTERVAL 300 SECOND END) AND r.as_of
  WHERE r.req_id NOT IN (SELECT req_id FROM bt)),
both_ AS (SELECT * FROM bt UNION ALL SELECT * FROM bs)
SELECT req_id, branch, line_id FROM (
  SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY ts DESC, line_id DESC) AS rn FROM both_) t
WHERE rn <= 50"""

# ---------------------------------------------------------------- poll ticks and stages

TICKS = 5  # at most so many 10-day slices have events; a slice without events changes nothing

TICK_GROUPS = """slices AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS s, as_of FROM (
  SELECT floor(epoch(ts) / 864000) AS f, max(ts) AS as_of FROM events GROUP BY 1) x),
tr0 AS (
  SELECT m.org_id, m.service, a.s, m.ts, m.rss_mb AS v,
    row_number() OVER (PARTITION BY a.s, m.org_id, m.service ORDER BY m.ts, m.id) - 1 AS rn,
    count(*) OVER (PARTITION BY a.s, m.org_id, m.service) AS n
  FROM metrics_v m JOIN slices a ON m.ts > a.as_of - INTERVAL 6 HOUR AND m.ts <= a.as_of WHERE m.rss_mb IS NOT NULL),
tr1 AS (SELECT s, org_id, service, any_value(n) AS n, min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l, max(ts) AS ts,
    CAST(sum(v) FILTER (rn < n // 2) AS DOUBLE) / count(v) FILTER (rn < n // 2) AS a1, CAST(sum(v) FILTER (rn >= n // 2) AS DOUBLE) / count(v) FILTER (rn >= n // 2) AS a2 FROM tr0 GROUP BY s, org_id, service),
breaches AS (
  SELECT sl.s, b.* FROM (SELECT * FROM mb UNION ALL SELECT * FROM lb) b JOIN slices sl ON floor(epoch(b.ts) / 864000) = sl.f
  UNION ALL SELECT s, org_id, service, 'rss_mb', (a2 - a1) / ((l - f) / 60000000.0), ts, 'warning', NULL, NULL, NULL,
    1, -1, 0 FROM tr1 WHERE n >= 4 AND l > f AND (a2 - a1) / ((l - f) / 60000000.0) >= 0.1 AND a2 >= 150.0)"""

TICK_VECTORS = """words AS (SELECT *, [CASE WHEN contains(signature_text, 'error_rate') THEN 1.0::DOUBLE ELSE 0 END,
    CASE WHEN contains(signature_text, 'p99_latency_ms') THEN 1 ELSE 0 END,
    CASE WHEN contains(signature_text, 'active_connections') THEN 1 ELSE 0 END,
    CASE WHEN contains(signature_text, 'log_error') THEN 1 ELSE 0 END,
    CASE WHEN contains(signature_text, 'rss_mb') THEN 1 ELSE 0 END,
    CASE WHEN contains(signature_text, 'severity=critical') THEN 1 ELSE 0 END] AS w FROM sig),
g AS (SELECT s, org_id, service, gs, first_ts, severity, list_transform(w, lambda x: x / sqrt(list_sum(w))) AS vec,
  (s + 1) * 1000000000 + row_number() OVER (PARTITION BY s ORDER BY first_ts, org_id, service) AS gid FROM words),
st0 AS (SELECT 0::BIGINT AS id, '' AS org_id, '' AS service, now()::TIMESTAMP AS opened_at, now()::TIMESTAMP AS updated_at,
  0::BIGINT AS occ, '' AS severity, 0.0::DOUBLE AS score, [0.0::DOUBLE] AS vec WHERE FALSE)"""


ORACLE["index_upkeep"] = with_views(CASES_V).rstrip().rstrip(",") + """,
final AS (
  SELECT id, org_id, primary_service, CASE WHEN id % 5 = 0 THEN signature_text || ' error_rate' ELSE signature_text END AS sig,
    CASE WHEN id % 3 <> 0 AND id % 5 <> 0 THEN 1 ELSE 2 END AS version
  FROM cases_v WHERE id % 7 <> 0 AND signature_text IS NOT NULL),
w AS (SELECT *, [""" + ", ".join(f"CASE WHEN contains(sig, '{x}') THEN 1.0::DOUBLE ELSE 0 END" for x in (
    "error_rate", "p99_latency_ms", "active_connections", "log_error", "rss_mb", "severity=critical")) + """] AS h FROM final)
SELECT id AS case_id, org_id, primary_service AS service, sha256(sig) AS digest,
  array_to_string(list_transform(h, lambda x: CAST(CAST(round(x / greatest(sqrt(list_sum(h)), 1), 4) AS DECIMAL(6,4)) AS VARCHAR)), ',') AS vector,
  version
FROM w"""


def _tick_sql(k: int, mode: str) -> str:
    pair = "round(list_inner_product(g.vec, c.vec), 6)"
    own = "c.org_id = g.org_id AND c.service = g.service AND c.updated_at >= a.as_of - INTERVAL 10 DAY"
    if mode == "pre_filter":
        hits = f"""SELECT g.gid, c.id, {pair} AS score, row_number() OVER (PARTITION BY g.gid ORDER BY {pair} DESC, c.id) AS r
  FROM g JOIN slices a ON a.s = g.s JOIN st{k} c ON {own} WHERE g.s = {k}"""
    else:
        hits = f"""SELECT gid, id, score, row_number() OVER (PARTITION BY gid ORDER BY r) AS r FROM (
    SELECT g.gid, c.id, {pair} AS score, {own} AS fits,
      row_number() OVER (PARTITION BY g.gid ORDER BY {pair} DESC, c.id) AS r
    FROM g JOIN slices a ON a.s = g.s CROSS JOIN st{k} c WHERE g.s = {k}) t WHERE r <= 5 AND fits"""
    return f"""h{k} AS ({hits}),
d{k} AS (SELECT g.*, a.as_of, h.score, h.score >= 0.86 AS dup, CASE WHEN h.score >= 0.86 THEN h.id ELSE g.gid END AS case_id
  FROM g JOIN slices a ON a.s = g.s LEFT JOIN h{k} h ON h.gid = g.gid AND h.r = 1 WHERE g.s = {k}),
m{k} AS (SELECT case_id, count(*) AS n, any_value(as_of) AS as_of, arg_max(score, (first_ts, gid)) AS score,
  bool_or(severity = 'critical') AS crit FROM d{k} WHERE dup GROUP BY case_id),
st{k + 1} AS (
  SELECT c.id, c.org_id, c.service, c.opened_at, coalesce(m.as_of, c.updated_at) AS updated_at, c.occ + coalesce(m.n, 0) AS occ,
    CASE WHEN m.crit THEN 'critical' ELSE c.severity END AS severity, coalesce(m.score, c.score) AS score, c.vec
  FROM st{k} c LEFT JOIN m{k} m ON m.case_id = c.id
  UNION ALL SELECT gid, org_id, service, first_ts, as_of, 1, severity, score, vec FROM d{k} WHERE NOT coalesce(dup, FALSE))"""


def _replay_sql(mode: str) -> str:
    by_slice = [x.replace("PARTITION BY org_id, service", "PARTITION BY s, org_id, service")
                .replace("org_id, service, gs", "s, org_id, service, gs") for x in (GROUPED, SIGNATURES)]
    steps = [_tick_sql(k, mode) for k in range(TICKS)]
    return with_views(METRICS_V, LOGS_V) + ",\n".join([MB, LB, TICK_GROUPS, *by_slice, TICK_VECTORS, *steps])


CASE_ROWS = f"""
SELECT id, org_id, service AS primary_service, {iso('opened_at')} AS opened_at, {iso('updated_at')} AS updated_at,
  occ::INTEGER AS occurrence_count, 'OPEN' AS status, severity, round(round(score, 4), 2) AS score FROM st{TICKS}"""

ORACLE["stream_recurrence"] = _replay_sql("pre_filter") + CASE_ROWS
ORACLE["recurrence_replay"] = _replay_sql("post_filter") + CASE_ROWS
ORACLE["stream_stages"] = _replay_sql("pre_filter") + f""",
assigned AS ({' UNION ALL '.join(f'SELECT s, org_id, service, gs, case_id FROM d{k}' for k in range(TICKS))}),
alerts AS (SELECT a.case_id, count(DISTINCT metric) AS n_alerts, count(*) AS n_breaches
  FROM grouped b JOIN assigned a USING (s, org_id, service, gs) GROUP BY a.case_id)
SELECT id, org_id, service AS primary_service, {iso('opened_at')} AS opened_at, TRUE AS summarized, TRUE AS matched,
  service || ' degradation' AS title, n_alerts, n_breaches, occ + 2 AS n_entries
FROM st{TICKS} JOIN alerts ON case_id = id"""
