"""Breach detection over metrics and logs (threshold, trend, error log).

All detectors return the same long "breach" shape::

    org_id, service, metric, value DOUBLE, ts, severity, event, message, trace_id,
    seq INT (0 metric, 1 trend, 2 log), src_id BIGINT, sub INT

``(ts, seq, src_id, sub)`` is the total order used downstream wherever the
order of breaches matters (sessions, sample messages).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import (DEFAULT_RULES, RSS_TREND_MIN_MB, RSS_TREND_SLOPE_MB_PER_MIN, RULE_BOUND,
                               breached, severity)

BREACH_COLUMNS = ("org_id", "service", "metric", "value", "ts", "severity", "event", "message",
                  "trace_id", "seq", "src_id", "sub")

SEQ_METRIC, SEQ_TREND, SEQ_LOG = 0, 1, 2


def _null_str() -> Column:
    return F.lit(None).cast("string")


def detect_metric_breaches(metrics: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Wide-to-long threshold breaches: one metrics row gives up to ``len(rules)`` breaches.

    A pre-filter (OR of the rule predicates) runs first so untouched rows never
    reach the explode; on a native parquet table it is pushed into the scan.
    """
    any_breach = reduce(lambda a, b: a | b, [breached(F.col(r.metric), r) for r in rules])
    cands = [
        F.when(breached(F.col(r.metric), r),
               F.struct(F.lit(r.metric).alias("metric"),
                        F.col(r.metric).cast("double").alias("value"),
                        severity(F.col(r.metric), r).alias("severity"),
                        F.lit(i).alias("sub")))
        for i, r in enumerate(rules)
    ]
    exploded = (metrics.where(any_breach)
                .select("org_id", "service", "ts", F.col("id").alias("src_id"),
                        F.explode(F.filter(F.array(*cands), lambda x: x.isNotNull())).alias("b")))
    return exploded.select(
        "org_id", "service", F.col("b.metric").alias("metric"), F.col("b.value").alias("value"), "ts",
        F.col("b.severity").alias("severity"), _null_str().alias("event"), _null_str().alias("message"),
        _null_str().alias("trace_id"), F.lit(SEQ_METRIC).alias("seq"), "src_id", F.col("b.sub").alias("sub"),
    )


# Columns that rules given as rows may name, and into how many parts each metric's values are dealt.
METRIC_COLUMNS = ("error_rate", "p99_latency_ms", "active_connections", "rss_mb")
RULE_PARTS = 64


def detect_by_rules(metrics: DataFrame, rules: DataFrame, columns=METRIC_COLUMNS) -> DataFrame:
    """Threshold breaches by rules that are rows (rule_id, metric, warn_from, critical_from), see ``rules_frame``.

    A row breaches a rule if its value is at or above ``warn_from``, critically from ``critical_from``. The
    lowest bound of each metric filters the scan before anything is unpivoted (one number per column goes to
    the driver). There are few metrics, so a join on the metric alone would meet in few tasks: values are dealt
    over ``RULE_PARTS`` parts by row id and each rule is copied to all parts. Rules of other columns or without
    ``warn_from`` never fire, without ``critical_from`` they only warn; null values breach nothing; no rules, no
    rows. ``sub`` is the rule's id.
    """
    lowest = (rules.where(F.col("metric").isin(*columns) & F.col("warn_from").isNotNull())
              .groupBy("metric").agg(F.min("warn_from").alias("low")))
    low = {r["metric"]: r["low"] for r in lowest.collect()}  # at most one row per column
    hit = {m: F.col(m) >= F.lit(v).cast(RULE_BOUND) for m, v in low.items()}
    any_hit = reduce(lambda a, b: a | b, hit.values(), F.lit(False))
    values = [F.when(h, F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
                                 F.col(m).cast(RULE_BOUND).alias("exact"))) for m, h in hit.items()]
    if not values:
        metrics, values = metrics.limit(0), [F.lit(None).cast(f"struct<metric:string,value:double,exact:{RULE_BOUND}>")]
    long = (metrics.where(any_hit)
            .select("org_id", "service", "ts", F.col("id").alias("src_id"),
                    F.inline(F.filter(F.array(*values), lambda x: x.isNotNull())))
            .withColumn("_part", F.pmod(F.xxhash64("src_id"), F.lit(RULE_PARTS)).cast("int")))
    copied = rules.select("rule_id", "metric", "warn_from", "critical_from",
                          F.explode(F.sequence(F.lit(0), F.lit(RULE_PARTS - 1))).alias("_part"))
    grade = F.when(F.col("exact") >= F.col("critical_from"), "critical").otherwise("warning")
    return (long.join(copied, ["metric", "_part"]).where(F.col("exact") >= F.col("warn_from"))
            .select("org_id", "service", "metric", "value", "ts", grade.alias("severity"), _null_str().alias("event"),
                    _null_str().alias("message"), _null_str().alias("trace_id"), F.lit(SEQ_METRIC).alias("seq"), "src_id",
                    F.col("rule_id").alias("sub")))


def detect_error_logs(logs: DataFrame) -> DataFrame:
    """ERROR / CRITICAL log rows become ``log_error`` breaches (value 1, critical)."""
    return logs.where(F.col("level").isin("ERROR", "CRITICAL")).select(
        "org_id", "service", F.lit("log_error").alias("metric"), F.lit(1.0).alias("value"), "ts",
        F.lit("critical").alias("severity"), "event", "message", "trace_id",
        F.lit(SEQ_LOG).alias("seq"), F.col("id").alias("src_id"), F.lit(0).alias("sub"),
    )


def trend_stats(metrics: DataFrame, keys, value_col: str = "rss_mb", bucket_seconds: float = 3600.0) -> DataFrame:
    """Per key: n, first/last ts and the means of the two halves of the ts-ordered values.

    Halves follow list slicing ``[0, n//2)`` and ``[n//2, n)`` (an odd extra row
    goes to the second half). Ranks are never computed over a whole key: rows
    are counted per (key, time bucket), bucket prefix counts locate the one
    bucket holding the split row, and only that bucket is ranked row by row.
    So a hot key costs one partial aggregate plus one bucket-sized sort.
    Values keep their type: decimals are added up exactly, in any order, and
    divided once, so the means do not depend on how rows were dealt.
    """
    keys = list(keys)
    bucket_us = int(bucket_seconds * 1_000_000)
    rows = (metrics.where(F.col(value_col).isNotNull())
            .select(*keys, F.unix_micros("ts").alias("us"), F.col("id").alias("rid"),
                    F.col(value_col).alias("v"))
            .withColumn("bucket", F.floor(F.col("us") / F.lit(bucket_us))))
    per_bucket = rows.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("v").alias("s"),
        F.min("us").alias("b_first"), F.max("us").alias("b_last"))
    by_key = Window.partitionBy(*keys)
    ordered = by_key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = (per_bucket
                  .withColumn("before", F.coalesce(F.sum("cnt").over(ordered), F.lit(0)))
                  .withColumn("n", F.sum("cnt").over(by_key))
                  .withColumn("mid", F.expr("n div 2")))
    head = per_bucket.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("mid").alias("mid"),
        F.sum("s").alias("s_all"),
        F.sum(F.when(F.col("before") + F.col("cnt") <= F.col("mid"), F.col("s"))).alias("s_full"),
        F.min("b_first").alias("first_us"), F.max("b_last").alias("last_us"),
        F.max(F.when((F.col("before") <= F.col("mid")) & (F.col("mid") < F.col("before") + F.col("cnt")),
                     F.col("bucket"))).alias("split_bucket"),
        F.max(F.when((F.col("before") <= F.col("mid")) & (F.col("mid") < F.col("before") + F.col("cnt")),
                     F.col("mid") - F.col("before"))).alias("take"),
    )
    # the split row lies in some bucket of every key: its rows carry the key's totals along
    local = Window.partitionBy(*keys, "bucket").orderBy("us", "rid")
    out = (rows.join(head.withColumnRenamed("split_bucket", "bucket"), [*keys, "bucket"])
           .withColumn("rn", F.row_number().over(local))
           .groupBy(*keys).agg(
               *[F.first(c).alias(c) for c in ("n", "mid", "s_all", "s_full", "first_us", "last_us")],
               F.sum(F.when(F.col("rn") <= F.col("take"), F.col("v"))).alias("s_part")))
    s1 = F.coalesce("s_full", F.lit(0)) + F.coalesce("s_part", F.lit(0))
    return out.select(
        *keys, "n", "first_us", "last_us",
        F.try_divide(s1.cast("double"), F.col("mid")).alias("avg1"),
        F.try_divide((F.col("s_all") - s1).cast("double"), F.col("n") - F.col("mid")).alias("avg2"),
    )


def detect_rss_trend(metrics: DataFrame, keys=("org_id", "service"),
                     slope_mb_per_min: float = RSS_TREND_SLOPE_MB_PER_MIN,
                     min_mb: float = RSS_TREND_MIN_MB, bucket_seconds: float = 3600.0) -> DataFrame:
    """Memory trend: n >= 4 non-null rss values, slope of the half means per minute.

    ``keys`` may include a window column (see ``detect_rss_trend_sliding``).
    """
    st = trend_stats(metrics, keys, "rss_mb", bucket_seconds)
    minutes = (F.col("last_us") - F.col("first_us")) / F.lit(60_000_000.0)
    slope = F.try_divide(F.col("avg2") - F.col("avg1"), minutes)
    res = (st.where((F.col("n") >= 4) & (minutes > 0))
           .withColumn("slope", slope)
           .where((F.col("slope") >= slope_mb_per_min) & (F.col("avg2") >= min_mb)))
    extra = [k for k in keys if k not in ("org_id", "service")]
    return res.select(
        "org_id", "service", *extra, F.lit("rss_mb").alias("metric"), F.col("slope").alias("value"),
        F.timestamp_micros("last_us").alias("ts"), F.lit("warning").alias("severity"),
        _null_str().alias("event"), _null_str().alias("message"), _null_str().alias("trace_id"),
        F.lit(SEQ_TREND).alias("seq"), F.lit(-1).cast("bigint").alias("src_id"), F.lit(0).alias("sub"),
    )


def detect_rss_trend_sliding(metrics: DataFrame, window: str = "120 seconds", slide: str = "10 seconds",
                             slope_mb_per_min: float = RSS_TREND_SLOPE_MB_PER_MIN,
                             min_mb: float = RSS_TREND_MIN_MB, bucket_seconds: float | None = None) -> DataFrame:
    """Trend over a trailing window evaluated at every slide (event time, not wall clock)."""
    w = metrics.where(F.col("rss_mb").isNotNull()).withColumn("win", F.window("ts", window, slide))
    w = w.withColumn("win_start", F.col("win.start")).withColumn("win_end", F.col("win.end")).drop("win")
    if bucket_seconds is None:
        bucket_seconds = _seconds(slide)
    out = detect_rss_trend(w, ("org_id", "service", "win_start", "win_end"), slope_mb_per_min, min_mb,
                           bucket_seconds)
    return out


def _seconds(interval: str) -> float:
    num, unit = interval.split()
    unit = unit.rstrip("s").lower()
    return float(num) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]


def all_breaches(metrics: DataFrame | None, logs: DataFrame | None, rules=DEFAULT_RULES, trend: bool = True,
                 trend_window: str = "120 seconds", trend_slide: str = "10 seconds",
                 slope_mb_per_min: float = RSS_TREND_SLOPE_MB_PER_MIN, min_mb: float = RSS_TREND_MIN_MB) -> DataFrame:
    """Union in detector order metric, trend, log (the ``seq`` column keeps the order).

    The memory trend looks back ``trend_window`` at every ``trend_slide``, as a poll does.
    """
    parts = []
    if metrics is not None:
        parts.append(detect_metric_breaches(metrics, rules))
        if trend:
            parts.append(detect_rss_trend_sliding(metrics, trend_window, trend_slide, slope_mb_per_min, min_mb))
    if logs is not None:
        parts.append(detect_error_logs(logs))
    parts = [p.select(*BREACH_COLUMNS) for p in parts]
    return reduce(lambda a, b: a.unionByName(b), parts)
