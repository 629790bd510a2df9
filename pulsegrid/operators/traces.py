"""Trace operators: per-trace roll-up, log enrichment, cascade edges, co-failure.

Nothing here pairs rows inside a trace: logs are joined to one roll-up row
per trace, edges come from ``lag`` over a trace's spans, and co-failing
services are pairs drawn from each trace's distinct error-service set, which
is bounded by the service vocabulary rather than by the trace's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trace_rollup(traces: DataFrame) -> DataFrame:
    order = F.struct(F.unix_micros("ts"), F.col("id"))
    return traces.groupBy("org_id", "trace_id").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.count_if("is_error").alias("n_errors"),
        F.sum(F.col("duration_ms").cast("double")).alias("total_ms"),
        F.min_by("service", F.when(F.col("is_error"), order)).alias("first_error_service"),
        F.max_by("span_name", F.struct(F.col("duration_ms"), -F.col("id"))).alias("slowest_span"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def logs_with_trace(logs: DataFrame, traces: DataFrame) -> DataFrame:
    """Each log row with its trace's roll-up (one row per log, NULLs when the trace has no spans)."""
    roll = trace_rollup(traces)
    return logs.join(roll.drop("first_ts", "last_ts"), ["org_id", "trace_id"], "left")


SPAN_COLUMNS = ("span_name", "duration_ms", "is_error", "error_code")


def logs_with_span(logs: DataFrame, traces: DataFrame) -> DataFrame:
    """Each log row with the first span of its own service in its trace (by ts, id); NULLs if there is none.

    Matching on the service too keeps one span per log; logs without a trace
    id are not moved.
    """
    spans = (traces.where(F.col("trace_id").isNotNull()).groupBy("org_id", "trace_id", "service")
             .agg(F.min_by(F.struct(*SPAN_COLUMNS), F.struct("ts", "id")).alias("_s"))
             .select("org_id", "trace_id", "service", *[F.col(f"_s.{c}").alias(c) for c in SPAN_COLUMNS]))
    traced = logs.where(F.col("trace_id").isNotNull()).join(spans, ["org_id", "trace_id", "service"], "left")
    return traced.unionByName(logs.where(F.col("trace_id").isNull()), allowMissingColumns=True)


def declared_edges(logs: DataFrame, traces: DataFrame) -> DataFrame:
    """Caller to callee edges that log contexts and span attributes name as ``downstream_service``."""
    def named(df: DataFrame, payload: str) -> DataFrame:
        return df.select("org_id", F.col("service").alias("src"),
                         F.get_json_object(payload, "$.downstream_service").alias("dst"))

    every = named(logs, "context").unionByName(named(traces, "attributes"))
    return (every.where(F.col("dst").isNotNull() & (F.col("dst") != "") & (F.col("dst") != F.col("src")))
            .groupBy("org_id", "src", "dst").agg(F.count(F.lit(1)).alias("n_edges")))


def service_edges(traces: DataFrame) -> DataFrame:
    """Caller to callee edges: consecutive spans of one trace (by ts, id) on different services."""
    w = Window.partitionBy("org_id", "trace_id").orderBy("ts", "id")
    prev = F.lag("service").over(w)
    return (traces.withColumn("src", prev).where(F.col("src").isNotNull() & (F.col("src") != F.col("service")))
            .groupBy("org_id", "src", F.col("service").alias("dst")).agg(F.count(F.lit(1)).alias("n_edges")))


def cascade_candidates(traces: DataFrame, cases: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Edges (by default of consecutive spans) whose callee has an open case; ``dst_is_root`` when the callee itself calls no open-case service."""
    edges = service_edges(traces) if edges is None else edges
    open_cases = (cases.where(F.col("status") != "RESOLVED")
                  .groupBy("org_id", F.col("primary_service").alias("dst"))
                  .agg(F.count(F.lit(1)).alias("dst_open_cases")))
    cand = edges.join(open_cases, ["org_id", "dst"], "inner")
    downstream_open = cand.select("org_id", F.col("src").alias("dst")).distinct()
    roots = cand.join(downstream_open, ["org_id", "dst"], "left_anti").select("org_id", "src", "dst") \
        .withColumn("dst_is_root", F.lit(True))
    return cand.join(roots, ["org_id", "src", "dst"], "left") \
        .withColumn("dst_is_root", F.coalesce("dst_is_root", F.lit(False)))


def cofailure_pairs(traces: DataFrame) -> DataFrame:
    per_trace = (traces.where(F.col("is_error")).select("org_id", "trace_id", "service").distinct()
                 .groupBy("org_id", "trace_id").agg(F.array_sort(F.collect_list("service")).alias("s")))
    pairs = per_trace.select("org_id", "trace_id", F.explode(
        F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")),
                                                            lambda b: F.struct(a.alias("a"), b.alias("b")))))
    ).alias("p"))
    return pairs.groupBy("org_id", F.col("p.a").alias("service_a"), F.col("p.b").alias("service_b")).agg(
        F.count(F.lit(1)).alias("n_traces"))
