"""DuckDB SQL text of the driver views (must equal ``pulsegrid.sources.views``).

Used only to build the oracle statements the driver runs against the same
parquet files; each constant is one ``name AS (...)`` CTE item.
"""

LOGS_V = """logs_v AS (
  SELECT event_id AS id, ts,
         'svc-' || CAST(user_id % 5 AS VARCHAR) AS service,
         CASE WHEN event_type = 'error' AND value >= 400.0 THEN 'CRITICAL'
              WHEN event_type = 'error' THEN 'ERROR'
              WHEN event_type = 'purchase' THEN 'WARN' ELSE 'INFO' END AS level,
         event_type AS event,
         't' || CAST(event_id // 4 AS VARCHAR) AS trace_id,
         event_type || ' value=' || printf('%.2f', value) AS message,
         props AS context,
         'org-' || CAST(user_id % 3 AS VARCHAR) AS org_id
  FROM events)"""

METRICS_V = """metrics_v AS (
  SELECT event_id AS id, ts,
         'svc-' || CAST(user_id % 5 AS VARCHAR) AS service,
         CAST((CAST(ROUND(value * 100) AS BIGINT) // 100) / 1000.0 AS DECIMAL(5,3)) AS error_rate,
         CASE WHEN event_type <> 'signup'
              THEN CAST(CAST(ROUND(value * 100) AS BIGINT) / 10.0 AS DECIMAL(8,1)) END AS p99_latency_ms,
         CAST(CAST(ROUND(value * 100) AS BIGINT) // 400 AS INTEGER) AS active_connections,
         CASE WHEN event_type <> 'view'
              THEN CAST((CAST(ROUND(value * 100) AS BIGINT) // 10) / 10.0 + 120 AS DECIMAL(8,1)) END AS rss_mb,
         'org-' || CAST(user_id % 3 AS VARCHAR) AS org_id
  FROM events)"""

TRACES_V = """traces_v AS (
  SELECT event_id AS id, ts,
         't' || CAST(event_id // 4 AS VARCHAR) AS trace_id,
         'svc-' || CAST(user_id % 5 AS VARCHAR) AS service,
         event_type AS span_name,
         CAST(CAST(ROUND(value * 100) AS BIGINT) / 10.0 AS DECIMAL(10,2)) AS duration_ms,
         event_type = 'error' AS is_error,
         CASE WHEN event_type = 'error'
              THEN 'E' || CAST(CAST(ROUND(value * 100) AS BIGINT) % 5 + 500 AS VARCHAR) END AS error_code,
         props AS attributes,
         'org-' || CAST(user_id % 3 AS VARCHAR) AS org_id
  FROM events)"""

LOG_LINES_V = """log_lines_v AS (
  SELECT event_id AS line_id, ts,
         'org-' || CAST(user_id % 3 AS VARCHAR) AS org_id,
         'app-' || CAST(user_id % 2 AS VARCHAR) AS app,
         CASE WHEN event_id % 97 = 0
              THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || lvl || ' ' || svc || ' ' || msg
              WHEN event_id % 13 = 0
              THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || lvl || ' [' || svc || '] ' || msg
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || lvl || ' [' || svc || '] ' || msg
                   || ' | k=' || k
                   || CASE WHEN event_id % 7 = 0 THEN ' | downstream_degraded' ELSE '' END
                   || CASE WHEN event_id % 11 = 0 THEN ' | k = ' || CAST(CAST(k AS INTEGER) + 1 AS VARCHAR)
                           ELSE '' END
                   || ' | trace_id=t' || CAST(event_id // 4 AS VARCHAR) END AS line
  FROM (SELECT *,
               CASE WHEN event_type = 'error' AND value >= 400.0 THEN 'CRITICAL'
                    WHEN event_type = 'error' THEN 'ERROR'
                    WHEN event_type = 'purchase' THEN 'WARN' ELSE 'INFO' END AS lvl,
               'svc-' || CAST(user_id % 5 AS VARCHAR) AS svc,
               event_type || ' value=' || printf('%.2f', value) AS msg,
               json_extract_string(props, '$.k') AS k
        FROM events) e)"""

CASES_V = """cases_v AS (
  SELECT o_orderkey AS id,
         'org-' || CAST(o_custkey % 3 AS VARCHAR) AS org_id,
         CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'INVESTIGATING' ELSE 'RESOLVED' END AS status,
         'svc-' || CAST(o_custkey % 5 AS VARCHAR) AS primary_service,
         o_orderdate AS opened_at,
         o_orderdate + to_hours(o_orderkey % 200 + 1) AS updated_at,
         'service=svc-' || CAST(o_custkey % 5 AS VARCHAR) || '; priority=' || o_orderpriority AS signature_text,
         CAST((CAST(ROUND(o_totalprice * 100) AS BIGINT) % 10000) / 10000.0 AS DECIMAL(5,4)) AS similarity_score,
         CAST(o_orderkey % 4 + 1 AS INTEGER) AS occurrence_count,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'critical'
              WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'warning' END AS severity,
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN ''
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
              ELSE 'svc-' || CAST(o_custkey % 5 AS VARCHAR) || ' ' || lower(o_orderpriority) END AS title,
         CASE WHEN o_orderstatus <> 'O' THEN 'Summary of case ' || CAST(o_orderkey AS VARCHAR) END AS ai_summary,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_hours(o_orderkey % 200 + 1) + INTERVAL 5 MINUTE END AS summarized_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours(o_orderkey % 200 + 1) + INTERVAL 10 MINUTE END AS matched_at
  FROM orders)"""

ALERTS_V = """alerts_v AS (
  SELECT l_orderkey * 8 + l_linenumber AS id,
         l_orderkey AS case_id,
         'stage1_poller' AS source_tool,
         'svc-' || CAST(l_suppkey % 5 AS VARCHAR) AS service,
         l_returnflag AS metric,
         CASE WHEN l_quantity > 25 THEN 'critical' ELSE 'warning' END AS severity,
         l_shipdate AS triggered_at,
         l_shipdate + to_minutes(CAST(l_linenumber AS BIGINT)) AS received_at,
         1 AS duplicate_count,
         l_quantity AS quantity
  FROM lineitem)"""

CASE_VECTORS_V = """case_vectors_v AS (
  SELECT vec_id AS case_id,
         'org-' || CAST(vec_id % 3 AS VARCHAR) AS org_id,
         'svc-' || CAST(label % 5 AS VARCHAR) AS service,
         label,
         embedding AS vector
  FROM embeddings)"""

TEAMS_V = """teams_v AS (
  SELECT n_nationkey AS id,
         'org-' || CAST(n_regionkey % 3 AS VARCHAR) AS org_id,
         n_name AS name,
         CASE WHEN n_nationkey % 6 = 5 THEN CAST([] AS VARCHAR[])
              WHEN n_nationkey % 4 = 0 THEN ['svc-' || CAST(n_nationkey % 5 AS VARCHAR),
                                             'svc-' || CAST((n_nationkey + 2) % 5 AS VARCHAR)]
              ELSE ['svc-' || CAST(n_nationkey % 5 AS VARCHAR)] END AS services
  FROM nation)"""

USERS_V = """users_v AS (
  SELECT c_custkey AS id,
         'org-' || CAST(n_regionkey % 3 AS VARCHAR) AS org_id,
         c_name AS name,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'org_admin' ELSE 'member' END AS role,
         c_nationkey AS team_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

INGEST_KEYS_V = """ingest_keys_v AS (
  SELECT s_suppkey AS id, s_nationkey AS team_id,
         sha256('key-' || CAST(s_suppkey AS VARCHAR)) AS key_hash,
         ['logs:write'] AS scopes,
         CASE WHEN s_acctbal < 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS revoked_at
  FROM supplier)"""

LOG_FILES_V = """log_files_v AS (
  SELECT doc_id, source AS filename, text AS line FROM documents)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + ",\n"

ENVELOPES_V = """envelopes_v AS (
  SELECT env_id, ts, org_id,
         CASE WHEN env_id % 5 = 0
              THEN '{' || st || '"labels":' || lbl || ',"context":' || ctx || '}'
              ELSE '{"alerts":[{' || st || '"labels":' || lbl || '},' || second || '],"context":' || ctx || '}'
         END AS payload
  FROM (
    SELECT e.event_id AS env_id, e.ts, 'org-' || CAST(e.user_id % 3 AS VARCHAR) AS org_id,
           CASE e.event_type WHEN 'view' THEN '"status":"resolved",' WHEN 'signup' THEN ''
                ELSE '"status":"firing",' END AS st,
           '{"alertname":"' || upper(substr(e.event_type, 1, 1)) || substr(e.event_type, 2, 100) || ' / '
             || CASE WHEN e.event_type = 'error' AND e.value >= 400.0 THEN 'CRITICAL'
                     WHEN e.event_type = 'error' THEN 'ERROR'
                     WHEN e.event_type = 'purchase' THEN 'WARN' ELSE 'INFO' END || '",'
             || CASE WHEN e.event_id % 3 = 0 THEN ''
                     WHEN e.event_id % 2 = 0 THEN '"service_name":"svc-' || CAST(e.user_id % 5 AS VARCHAR) || '",'
                     ELSE '"service":"svc-' || CAST(e.user_id % 5 AS VARCHAR) || '",' END
             || '"app":"app-' || CAST(e.user_id % 2 AS VARCHAR) || '"}' AS lbl,
           '{"status":"firing","labels":{"alertname":"","service":"svc-' || CAST((e.user_id + 1) % 5 AS VARCHAR)
             || '","job":"job-' || CAST(e.user_id % 4 AS VARCHAR) || '"}}' AS second,
           '{"logs":["' || l.line || '"]}' AS ctx
    FROM events e JOIN log_lines_v l ON l.line_id = e.event_id) x)"""

INGEST_REQUESTS_V = """ingest_requests_v AS (
  SELECT event_id AS request_id, ts,
         CASE WHEN user_id % 10 = 9 THEN NULL ELSE 'key-' || CAST(user_id AS VARCHAR) END AS api_key,
         CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'org-' || CAST(user_id % 3 AS VARCHAR) END AS body_org,
         CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'org-' || CAST((user_id + 1) % 3 AS VARCHAR) END AS requested_org
  FROM events)"""

ORGS_V = """orgs_v AS (SELECT DISTINCT 'org-' || CAST(r_regionkey % 3 AS VARCHAR) AS org_id FROM region)"""
