"""Batch ingest of JSON request bodies (logs, spans, metrics, cases, alerts).

A request body is a JSON array of entries. Ingest is all-or-nothing per
body: a body over the size cap, an unparseable one, or one with an entry
that lacks a required field is refused whole. The client therefore cuts its
rows into bodies that fit (``number_bodies``), and what the server refuses is
returned with the reason and the number of rows (``refused_bodies``): rows
sent are rows accepted plus rows refused. Row timestamps are the body's
receive time (the server sets ``ts``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ingest limits.
MAX_BATCH_ROWS = 5000

LOG_ENTRY = ("struct<service:string,level:string,event:string,traceId:string,message:string,"
             "context:map<string,string>,orgId:string>")
SPAN_ENTRY = ("struct<traceId:string,service:string,spanName:string,durationMs:decimal(10,2),isError:boolean,"
              "errorCode:string,attributes:map<string,string>,orgId:string>")
METRIC_ENTRY = ("struct<service:string,errorRate:decimal(5,3),p99LatencyMs:decimal(8,1),activeConnections:int,"
                "rssMb:decimal(8,1),orgId:string>")
ALERT_ENTRY = ("struct<caseId:bigint,sourceTool:string,rawAlertId:string,service:string,metric:string,"
               "severity:string,triggeredAt:timestamp,duplicateCount:int,orgId:string>")

CASE_ENTRY = ("struct<status:string,primaryService:string,openedAt:timestamp,signatureText:string,"
              "similarityScore:decimal(5,4),occurrenceCount:int,severity:string,orgId:string>")

REQUIRED = {
    CASE_ENTRY: ("primaryService",),
    LOG_ENTRY: ("service", "level", "event"),
    SPAN_ENTRY: ("traceId", "service", "spanName"),
    METRIC_ENTRY: ("service",),
    ALERT_ENTRY: ("caseId", "service", "metric"),
}


def batch_guard(rows: DataFrame, batch_cols, cap: int = MAX_BATCH_ROWS) -> DataFrame:
    """Per batch: size and whether it is accepted (size <= cap)."""
    return (rows.groupBy(*batch_cols).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("accepted", F.col("n_rows") <= cap))


def number_bodies(rows: DataFrame, batch_cols, order_col: str, ts_col: str = "ts", cap: int = MAX_BATCH_ROWS,
                  bucket_seconds: float = 3600.0) -> DataFrame:
    """Client side: adds ``body_no`` and ``body_pos``; a batch is cut every ``cap`` rows in time order.

    Rows are numbered inside (batch, time bucket) and shifted by the counts of
    the buckets before, so no batch is sorted in one task.
    """
    keys = list(batch_cols)
    b = rows.withColumn("_tb", F.floor(F.unix_micros(ts_col) / F.lit(int(bucket_seconds * 1_000_000))))
    before = Window.partitionBy(*keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (b.groupBy(*keys, "_tb").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    at = F.row_number().over(Window.partitionBy(*keys, "_tb").orderBy(order_col)) + F.col("_off") - 1
    return (b.join(offsets, [*keys, "_tb"]).withColumn("_at", at)
            .withColumn("body_no", F.floor(F.col("_at") / cap).cast("bigint"))
            .withColumn("body_pos", (F.col("_at") % cap).cast("bigint")).drop("_tb", "_off", "_at"))


def build_bodies(rows: DataFrame, batch_cols, entry: Column, order_col: str = "body_pos",
                 received_col: str = "ts") -> DataFrame:
    """Client side: one JSON array body per batch (of numbered, hence bounded rows), in ``order_col`` order."""
    return rows.groupBy(*batch_cols).agg(
        F.to_json(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), entry.alias("e"))),
                         lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)),
            lambda x: x["e"])).alias("body"),
        F.max(received_col).alias("received_at"))


def _judged(bodies: DataFrame, entry_schema: str, body_col: str, cap: int) -> DataFrame:
    """The bodies with their entries and the reason why they are refused (NULL: accepted)."""
    parsed = bodies.withColumn("_entries", F.from_json(F.col(body_col), f"array<{entry_schema}>"))
    complete = F.forall("_entries", lambda e: e.isNotNull() & F.forall(
        F.array(*[e[f].isNotNull() for f in REQUIRED[entry_schema]]), lambda x: x))
    return parsed.withColumn("_reason", F.when(F.col("_entries").isNull(), F.lit("unparseable"))
                             .when(F.size("_entries") > cap, F.lit("too_many_rows"))
                             .when(~complete, F.lit("missing_field")))


def parse_bodies(bodies: DataFrame, entry_schema: str, body_col: str = "body", cap: int = MAX_BATCH_ROWS) -> DataFrame:
    """Server side: entries of the bodies that pass every check (pos kept)."""
    ok = _judged(bodies, entry_schema, body_col, cap).where(F.col("_reason").isNull())
    return ok.select(*[c for c in bodies.columns if c != body_col],
                     F.posexplode("_entries").alias("pos", "entry"))


def refused_bodies(bodies: DataFrame, entry_schema: str, body_col: str = "body", cap: int = MAX_BATCH_ROWS) -> DataFrame:
    """Server side: the bodies refused, with ``reason`` and ``n_rows`` (NULL if unparseable)."""
    bad = _judged(bodies, entry_schema, body_col, cap).where(F.col("_reason").isNotNull())
    return bad.select(*[c for c in bodies.columns if c != body_col], F.col("_reason").alias("reason"),
                      F.when(F.col("_entries").isNotNull(), F.size("_entries")).cast("bigint").alias("n_rows"))
