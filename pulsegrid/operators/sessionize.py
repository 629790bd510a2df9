"""Gap sessionization (breach grouping) and group roll-up.

A new group starts when the gap to the previous row of the same key is
greater than ``gap_seconds``; a gap exactly equal to it stays in the group.

Two-level plan so a hot key (one service holding a third of all rows) is
spread over many tasks:

1. rows are sessionized inside (key, time bucket) partitions with ``lag`` and a
   running sum, in parallel;
2. one summary row per (key, bucket) says whether the bucket's first session
   continues the previous non-empty bucket's last session; a forward fill over
   these few summary rows resolves chains that span several buckets;
3. the summary is joined back and each row gets its group's start time.

This is exact: a session is fully determined by its first and last rows, and
only the first session of a bucket can continue an earlier bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP_START = "group_start"


def sessionize(df: DataFrame, keys, gap_seconds: float, ts_col: str = "ts",
               order_cols=(), bucket_seconds: float = 3600.0, out_col: str = GROUP_START) -> DataFrame:
    keys = list(keys)
    gap_us = int(round(gap_seconds * 1_000_000))
    bucket_us = int(bucket_seconds * 1_000_000)
    rows = (df.withColumn("_us", F.unix_micros(F.col(ts_col)))
            .withColumn("_bucket", F.floor(F.col("_us") / F.lit(bucket_us))))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_us", *order_cols)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev = F.lag("_us").over(w)
    rows = rows.withColumn("_new", prev.isNull() | ((F.col("_us") - prev) > gap_us))
    rows = (rows.withColumn("_sid", F.sum(F.col("_new").cast("int")).over(running))
            .withColumn("_sstart", F.max(F.when(F.col("_new"), F.col("_us"))).over(running)))

    summary = rows.groupBy(*keys, "_bucket").agg(
        F.min("_us").alias("_b_first"), F.max("_us").alias("_b_last"),
        F.max("_sid").alias("_b_n"), F.max("_sstart").alias("_b_last_start"))
    kw = Window.partitionBy(*keys).orderBy("_bucket")
    prev_last = F.lag("_b_last").over(kw)
    summary = summary.withColumn("_merge", prev_last.isNotNull() & ((F.col("_b_first") - prev_last) <= gap_us))
    anchor = F.when((F.col("_b_n") > 1) | ~F.col("_merge"), F.col("_b_last_start"))
    summary = summary.withColumn(
        "_resolved", F.max(anchor).over(kw.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    summary = summary.withColumn(
        "_first_group",
        F.when(F.col("_merge"), F.lag("_resolved").over(kw)).otherwise(F.col("_b_first")))

    joined = rows.join(summary.select(*keys, "_bucket", "_merge", "_first_group"), [*keys, "_bucket"], "inner")
    start = F.when((F.col("_sid") == 1) & F.col("_merge"), F.col("_first_group")).otherwise(F.col("_sstart"))
    return (joined.withColumn(out_col, F.timestamp_micros(start))
            .drop("_us", "_bucket", "_new", "_sid", "_sstart", "_merge", "_first_group"))


def sessionize_plain(df: DataFrame, keys, gap_seconds: float, ts_col: str = "ts", order_cols=(),
                     out_col: str = GROUP_START) -> DataFrame:
    """Single-level form (``lag`` + running sum over the whole key); reference for tests."""
    keys = list(keys)
    gap_us = int(round(gap_seconds * 1_000_000))
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(ts_col)), *order_cols)
    us = F.unix_micros(F.col(ts_col))
    prev = F.lag(us).over(w)
    new = prev.isNull() | ((us - prev) > gap_us)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("_st", F.max(F.when(new, us)).over(running))
    return out.withColumn(out_col, F.timestamp_micros("_st")).drop("_st")


def session_rollup(df: DataFrame, keys, gap_seconds: float, ts_col: str = "ts", order_cols=("seq", "src_id", "sub"),
                   bucket_seconds: float = 3600.0, out_col: str = GROUP_START) -> DataFrame:
    """Sessions rolled up in one pass: ``group_rollup`` of ``sessionize`` and the first two sample messages.

    Rows are folded into one summary per session part (key, time bucket, session in the bucket): first and
    last time, count, whether critical, the small metric and event sets, and its first two distinct
    critical messages with their places. Summaries merge: the parts of a session are found from their
    times alone by one window over the summaries, and every field of the whole comes from the fields of
    the parts. The rows are read and moved once, by (key, bucket), so a hot key is spread over its buckets;
    what is ordered by key is a few summaries an hour. The second message is the first one among the
    parts' that differs from the session's first, which each part's two messages suffice to tell.
    """
    keys = list(keys)
    gap_us, bucket_us = int(round(gap_seconds * 1_000_000)), int(bucket_seconds * 1_000_000)
    said = (F.col("severity") == "critical") & F.col("message").isNotNull() & (F.col("message") != "")
    rows = (df.withColumn("_us", F.unix_micros(F.col(ts_col)))
            .select(*keys, "_us", F.floor(F.col("_us") / F.lit(bucket_us)).alias("_bucket"), *order_cols,
                    (F.col("severity") == "critical").alias("_critical"), "metric",
                    F.when(F.col("event") != "", F.col("event")).alias("event"),
                    F.when(said, F.struct("_us", *order_cols, "message")).alias("_said")))
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy("_us", *order_cols)
    before = F.lag("_us").over(in_bucket)
    rows = (rows.withColumn("_new", before.isNull() | (F.col("_us") - before > gap_us))
            .withColumn("_part", F.sum(F.col("_new").cast("int")).over(
                in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .withColumn("_one", F.min("_said").over(Window.partitionBy(*keys, "_bucket", "_part"))))
    parts = rows.groupBy(*keys, "_bucket", "_part").agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count(F.lit(1)).alias("_n"),
        F.bool_or("_critical").alias("_critical"), F.array_sort(F.collect_set("metric")).alias("_metrics"),
        F.array_sort(F.collect_set("event")).alias("_events"), F.min("_one").alias("_one"),
        F.min(F.when(F.col("_said.message") != F.col("_one.message"), F.col("_said"))).alias("_two"))

    by_key = Window.partitionBy(*keys).orderBy("_bucket", "_part")
    end = F.lag("_last").over(by_key)
    begins = F.when(end.isNull() | (F.col("_first") - end > gap_us), F.col("_first"))
    parts = (parts.withColumn("_begins", begins)
             .withColumn("_start", F.max("_begins").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
             .withColumn("_whole", F.min("_one").over(Window.partitionBy(*keys, "_start")))
             .withColumn("_other", F.when(F.col("_one.message") == F.col("_whole.message"), F.col("_two"))
                         .otherwise(F.col("_one"))))
    return parts.groupBy(*keys, F.timestamp_micros("_start").alias(out_col)).agg(
        F.timestamp_micros(F.min("_first")).alias("first_ts"), F.timestamp_micros(F.max("_last")).alias("last_ts"),
        F.sum("_n").alias("n_breaches"),
        F.when(F.bool_or(F.coalesce("_critical", F.lit(False))), "critical").otherwise("warning").alias("severity"),
        # sets over small vocabularies: as many different arrays as their combinations, at most
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_metrics")))).alias("metrics"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_events")))).alias("events"),
        F.filter(F.array(F.min("_whole")["message"], F.min("_other")["message"]),
                 lambda m: m.isNotNull()).alias("samples"))


def group_rollup(grouped: DataFrame, keys=("org_id", "service"), group_col: str = GROUP_START) -> DataFrame:
    """first_ts, last_ts, size, severity (critical if any), sorted distinct metrics and events.

    Only bounded aggregates are used (min/max/count/bool_or and sets over the
    small metric and event vocabularies), so partial aggregation collapses a
    huge group before the shuffle; members stay as rows keyed by the group.
    """
    keys = list(keys)
    return grouped.groupBy(*keys, group_col).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("n_breaches"),
        F.when(F.bool_or(F.col("severity") == "critical"), "critical").otherwise("warning").alias("severity"),
        F.array_sort(F.collect_set("metric")).alias("metrics"),
        F.array_sort(F.collect_set(F.when(F.col("event") != "", F.col("event")))).alias("events"),
    )

