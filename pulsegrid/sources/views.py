"""Driver views: the generic driver tables re-shaped into the native telemetry shapes.

Each view is a pure projection (plus, for users, a join with a 25-row
dimension) over one driver table, so Catalyst prunes columns and pushes
filters through it into the parquet scan. The same definitions are written in
DuckDB SQL in ``pulsegrid.plans.oracle`` for the correctness check; keep both
in step (FIXTURES.md documents them).

Measures are derived from integer cents of ``events.value`` so both engines get
the same exact decimals (no binary-float rounding ties).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Fixed values of the view definitions (shared with the SQL oracle).
N_SERVICES = 5
N_ORGS = 3
CRITICAL_LOG_VALUE = 400.0
SOURCE_TOOL = "stage1_poller"


def _svc(col: str) -> Column:
    return F.concat(F.lit("svc-"), (F.col(col) % N_SERVICES).cast("string"))


def _org(col: str) -> Column:
    return F.concat(F.lit("org-"), (F.col(col) % N_ORGS).cast("string"))


def _cents(col: str = "value") -> Column:
    return F.round(F.col(col) * 100).cast("bigint")


def _level() -> Column:
    return (F.when((F.col("event_type") == "error") & (F.col("value") >= CRITICAL_LOG_VALUE), "CRITICAL")
            .when(F.col("event_type") == "error", "ERROR")
            .when(F.col("event_type") == "purchase", "WARN")
            .otherwise("INFO"))


def _trace_id() -> Column:
    return F.concat(F.lit("t"), F.expr("event_id div 4").cast("string"))


def _message() -> Column:
    return F.concat(F.col("event_type"), F.lit(" value="), F.format_string("%.2f", F.col("value")))


def logs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from(table(spark, sf_dir, "events"))


def logs_from(ev: DataFrame) -> DataFrame:
    """logs shape from an events DataFrame (batch or streaming)."""
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        _svc("user_id").alias("service"),
        _level().alias("level"),
        F.col("event_type").alias("event"),
        _trace_id().alias("trace_id"),
        _message().alias("message"),
        F.col("props").alias("context"),
        _org("user_id").alias("org_id"),
    )


def metrics_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_from(table(spark, sf_dir, "events"))


def metrics_from(ev: DataFrame) -> DataFrame:
    """metrics shape from an events DataFrame (batch or streaming)."""
    cents = _cents()
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        _svc("user_id").alias("service"),
        ((cents.cast("decimal(12,0)") / 100).cast("bigint").cast("decimal(10,0)") / 1000)
        .cast("decimal(5,3)").alias("error_rate"),
        F.when(F.col("event_type") != "signup", (cents.cast("decimal(12,0)") / 10).cast("decimal(8,1)"))
        .alias("p99_latency_ms"),
        F.expr("CAST(CAST(ROUND(value * 100) AS BIGINT) div 400 AS INT)").alias("active_connections"),
        F.when(F.col("event_type") != "view",
               (F.expr("CAST(ROUND(value * 100) AS BIGINT) div 10").cast("decimal(12,0)") / 10 + 120)
               .cast("decimal(8,1)")).alias("rss_mb"),
        _org("user_id").alias("org_id"),
    )


def traces_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    is_error = F.col("event_type") == "error"
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        _trace_id().alias("trace_id"),
        _svc("user_id").alias("service"),
        F.col("event_type").alias("span_name"),
        (_cents().cast("decimal(12,0)") / 10).cast("decimal(10,2)").alias("duration_ms"),
        is_error.alias("is_error"),
        F.when(is_error, F.concat(F.lit("E"), (_cents() % 5 + 500).cast("string"))).alias("error_code"),
        F.col("props").alias("attributes"),
        _org("user_id").alias("org_id"),
    )


def _wire_line() -> Column:
    """Events rendered as wire log lines ``date time LEVEL [service] message | k=v | trace_id=..``.

    Some lines carry a piece without ``=``, a repeated key, no context at all,
    or lose their brackets (unparseable), so every parser branch is exercised.
    """
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    k = F.get_json_object("props", "$.k")
    head = F.concat(stamp, F.lit(" "), _level(), F.lit(" ["), _svc("user_id"), F.lit("] "), _message())
    pieces = F.concat(
        F.lit(" | k="), k,
        F.when(F.col("event_id") % 7 == 0, F.lit(" | downstream_degraded")).otherwise(F.lit("")),
        F.when(F.col("event_id") % 11 == 0, F.concat(F.lit(" | k = "), (k.cast("int") + 1).cast("string")))
        .otherwise(F.lit("")),
        F.lit(" | trace_id="), _trace_id(),
    )
    return (F.when(F.col("event_id") % 97 == 0,
                   F.concat(stamp, F.lit(" "), _level(), F.lit(" "), _svc("user_id"), F.lit(" "), _message()))
            .when(F.col("event_id") % 13 == 0, head)
            .otherwise(F.concat(head, pieces)))


def log_lines_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("line_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        _org("user_id").alias("org_id"),
        F.concat(F.lit("app-"), (F.col("user_id") % 2).cast("string")).alias("app"),
        _wire_line().alias("line"),
    )


def envelopes_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert-webhook JSON payload per event, carrying the event's wire line inline.

    Every fifth payload is a bare alert (no ``alerts`` list); ``view`` events
    are resolved, ``signup`` ones omit the status (defaults to firing); a
    third of the first alerts lack a service label so the header scan has to
    move on to the second alert.
    """
    ev = table(spark, sf_dir, "events")
    svc = _svc("user_id")
    name = F.concat(F.upper(F.substring("event_type", 1, 1)), F.substring("event_type", 2, 100),
                    F.lit(" / "), _level())
    svc_part = (F.when(F.col("event_id") % 3 == 0, F.lit(""))
                .when(F.col("event_id") % 2 == 0, F.concat(F.lit('"service_name":"'), svc, F.lit('",')))
                .otherwise(F.concat(F.lit('"service":"'), svc, F.lit('",'))))
    labels = F.concat(F.lit('{"alertname":"'), name, F.lit('",'), svc_part, F.lit('"app":"app-'),
                      (F.col("user_id") % 2).cast("string"), F.lit('"}'))
    status = (F.when(F.col("event_type") == "view", F.lit('"status":"resolved",'))
              .when(F.col("event_type") == "signup", F.lit(""))
              .otherwise(F.lit('"status":"firing",')))
    first = F.concat(F.lit("{"), status, F.lit('"labels":'), labels, F.lit("}"))
    second = F.concat(F.lit('{"status":"firing","labels":{"alertname":"","service":"svc-'),
                      ((F.col("user_id") + 1) % N_SERVICES).cast("string"), F.lit('","job":"job-'),
                      (F.col("user_id") % 4).cast("string"), F.lit('"}}'))
    context = F.concat(F.lit('{"logs":["'), _wire_line(), F.lit('"]}'))
    payload = (F.when(F.col("event_id") % 5 == 0,
                      F.concat(F.lit("{"), status, F.lit('"labels":'), labels, F.lit(',"context":'), context,
                               F.lit("}")))
               .otherwise(F.concat(F.lit('{"alerts":['), first, F.lit(","), second, F.lit('],"context":'),
                                   context, F.lit("}"))))
    return ev.select(F.col("event_id").alias("env_id"), F.col("ts").cast("timestamp").alias("ts"),
                     _org("user_id").alias("org_id"), payload.alias("payload"))


def cases_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    opened = F.col("o_orderdate").cast("timestamp")
    updated = opened + F.make_dt_interval(days=F.lit(0), hours=(F.col("o_orderkey") % 200 + 1).cast("int"))
    status = (F.when(F.col("o_orderstatus") == "O", "OPEN")
              .when(F.col("o_orderstatus") == "P", "INVESTIGATING")
              .otherwise("RESOLVED"))
    prio = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("id"),
        _org("o_custkey").alias("org_id"),
        status.alias("status"),
        _svc("o_custkey").alias("primary_service"),
        opened.alias("opened_at"),
        updated.alias("updated_at"),
        F.concat(F.lit("service="), _svc("o_custkey"), F.lit("; priority="), prio).alias("signature_text"),
        ((_cents("o_totalprice") % 10000).cast("decimal(10,0)") / 10000).cast("decimal(5,4)")
        .alias("similarity_score"),
        (F.col("o_orderkey") % 4 + 1).cast("int").alias("occurrence_count"),
        F.when(prio.isin("1-URGENT", "2-HIGH"), "critical").when(prio == "5-LOW", F.lit(None))
        .otherwise("warning").alias("severity"),
        F.when(prio == "3-MEDIUM", F.lit("")).when(prio == "4-NOT SPECIFIED", F.lit(None))
        .otherwise(F.concat(_svc("o_custkey"), F.lit(" "), F.lower(prio))).alias("title"),
        F.when(F.col("o_orderstatus") != "O",
               F.concat(F.lit("Summary of case "), F.col("o_orderkey").cast("string"))).alias("ai_summary"),
        F.when(F.col("o_orderstatus") != "O", updated + F.expr("INTERVAL 5 MINUTES")).alias("summarized_at"),
        F.when(F.col("o_orderstatus") == "F", updated + F.expr("INTERVAL 10 MINUTES")).alias("matched_at"),
    )


def alerts_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    trig = F.col("l_shipdate").cast("timestamp")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("case_id"),
        F.lit(SOURCE_TOOL).alias("source_tool"),
        _svc("l_suppkey").alias("service"),
        F.col("l_returnflag").alias("metric"),
        F.when(F.col("l_quantity") > 25, "critical").otherwise("warning").alias("severity"),
        trig.alias("triggered_at"),
        F.timestamp_seconds(F.unix_seconds(trig) + F.col("l_linenumber") * 60).alias("received_at"),
        F.lit(1).alias("duplicate_count"),
        F.col("l_quantity").alias("quantity"),
    )


def case_vectors_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("case_id"),
        _org("vec_id").alias("org_id"),
        _svc("label").alias("service"),
        F.col("label"),
        F.col("embedding").alias("vector"),
    )


def teams_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    first = F.concat(F.lit("svc-"), (F.col("n_nationkey") % N_SERVICES).cast("string"))
    second = F.concat(F.lit("svc-"), ((F.col("n_nationkey") + 2) % N_SERVICES).cast("string"))
    services = (F.when(F.col("n_nationkey") % 6 == 5, F.array().cast("array<string>"))
                .when(F.col("n_nationkey") % 4 == 0, F.array(first, second))
                .otherwise(F.array(first)))
    return n.select(
        F.col("n_nationkey").alias("id"),
        F.concat(F.lit("org-"), (F.col("n_regionkey") % N_ORGS).cast("string")).alias("org_id"),
        F.col("n_name").alias("name"),
        services.alias("services"),
    )


def users_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer rows as users; a user's org is that of their team (nation)."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # nation is a fixed 25-row dimension: broadcasting it is size-bounded.
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "inner")
            .select(
                F.col("c_custkey").alias("id"),
                F.concat(F.lit("org-"), (F.col("n_regionkey") % N_ORGS).cast("string")).alias("org_id"),
                F.col("c_name").alias("name"),
                F.when(F.col("c_mktsegment") == "BUILDING", "org_admin").otherwise("member").alias("role"),
                F.col("c_nationkey").alias("team_id"),
            ))


def ingest_keys_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_nationkey").alias("team_id"),
        F.sha2(F.concat(F.lit("key-"), F.col("s_suppkey").cast("string")), 256).alias("key_hash"),
        F.array(F.lit("logs:write")).alias("scopes"),
        F.when(F.col("s_acctbal") < 0, F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("revoked_at"),
    )


def log_files_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id"), F.col("source").alias("filename"), F.col("text").alias("line"))


def ingest_requests_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ingest/read request per event: presented key (none = trusted caller), body and requested org."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("user_id") % 10 == 9, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("key-"), F.col("user_id").cast("string"))).alias("api_key"),
        F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string"))
        .otherwise(_org("user_id")).alias("body_org"),
        F.when(F.col("event_id") % 6 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("org-"), ((F.col("user_id") + 1) % N_ORGS).cast("string"))).alias("requested_org"),
    )


def orgs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(F.concat(F.lit("org-"), (F.col("r_regionkey") % N_ORGS).cast("string")).alias("org_id")).distinct()
