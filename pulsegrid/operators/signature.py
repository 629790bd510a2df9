"""Case signature text per breach group.

``service=S; metrics=[a, b]; events=[e]; severity=X; sample_messages="m1; m2"``

* metrics: sorted distinct; events: sorted distinct non-empty, part omitted when none;
* severity: critical if any member is critical;
* sample messages: the first two distinct non-empty messages of critical
  members in group order (distinct on the full text), each cut to 200 chars;
  part omitted when none. No ids or times, so recurrences give equal text.

The first-two pick is bounded: messages are first reduced to their earliest
position per (group, message), then a ``row_number() <= 2`` filter, which
Spark plans as a partial per-partition group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sessionize import GROUP_START, group_rollup, session_rollup

MESSAGE_CHARS = 200
SAMPLE_MESSAGES = 2


def sample_messages(grouped: DataFrame, keys=("org_id", "service"), group_col: str = GROUP_START,
                    k: int = SAMPLE_MESSAGES) -> DataFrame:
    keys = [*keys, group_col]
    crit = grouped.where((F.col("severity") == "critical") & F.col("message").isNotNull()
                         & (F.col("message") != ""))
    first_seen = crit.groupBy(*keys, "message").agg(
        F.min(F.struct(F.unix_micros("ts").alias("us"), "seq", "src_id", "sub")).alias("pos"))
    w = Window.partitionBy(*keys).orderBy("pos")
    top = first_seen.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return top.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))),
                    lambda x: x["message"]).alias("samples"))


def signature_text(service: Column, metrics: Column, events: Column, severity: Column,
                   samples: Column) -> Column:
    cut = F.transform(samples, lambda m: F.substring(m, 1, MESSAGE_CHARS))
    return F.concat_ws(
        "; ",
        F.concat(F.lit("service="), service),
        F.concat(F.lit("metrics=["), F.array_join(metrics, ", "), F.lit("]")),
        F.when(F.size(events) > 0, F.concat(F.lit("events=["), F.array_join(events, ", "), F.lit("]"))),
        F.concat(F.lit("severity="), severity),
        F.when(F.coalesce(F.size(samples), F.lit(0)) > 0,
               F.concat(F.lit('sample_messages="'), F.array_join(cut, "; "), F.lit('"'))),
    )


def group_signatures(grouped: DataFrame, keys=("org_id", "service"), group_col: str = GROUP_START) -> DataFrame:
    """Roll-up of each group plus its ``signature_text``."""
    keys = list(keys)
    roll = group_rollup(grouped, keys, group_col)
    samples = sample_messages(grouped, keys, group_col)
    out = roll.join(samples, [*keys, group_col], "left")
    return out.withColumn(
        "signature_text",
        signature_text(F.col("service"), F.col("metrics"), F.col("events"), F.col("severity"),
                       F.coalesce(F.col("samples"), F.array().cast("array<string>"))))


def session_signatures(breaches: DataFrame, gap_seconds: float, keys=("org_id", "service")) -> DataFrame:
    """``group_signatures`` of the gap sessions of ``breaches``, from one pass over them."""
    out = session_rollup(breaches, keys, gap_seconds)
    return out.withColumn("signature_text", signature_text(
        F.col("service"), F.col("metrics"), F.col("events"), F.col("severity"), F.col("samples")))
