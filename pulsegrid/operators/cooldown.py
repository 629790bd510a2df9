"""Alert cooldown: per key, an alert fires only if at least ``cooldown`` has passed since the last FIRED one.

Whether an alert fires depends on all earlier decisions of its key, so a key cannot be cut into
independent pieces - but it can be cut into functions. Time is cut into buckets as long as the
cooldown, and what a stretch of buckets does is a function of one value, the moment from which an
alert may fire again:

* Bucket: at most one alert of it fires, the first one at or after that moment, and moves the
  moment to ``us + cooldown``, which lies in a later bucket; if there is none, the moment stays.
* Stretch: the composition of its two halves. A moment on entry lies in the first bucket of the
  stretch or before it, so the function is a step function whose steps come from the first half;
  steps with equal values are one step, since the function never falls.

The functions are composed upwards by pairs (a prefix scan over time), then the moments go down the
same tree, and each bucket picks its alert. There are log2(time span / cooldown) levels each way. A
level holds the steps of every other bucket of the level below, so all levels together are of the
size of the alerts. Only step functions are shuffled, by (key, stretch); a key that holds most rows
is spread over its buckets. Levels are checkpointed to the shared folder, so a lost executor costs
no recomputation of the levels below.

Defined results: of alerts at the same moment the smallest id fires; alerts without a time never
fire; null keys are keys; a cooldown of nothing lets the first alert of each moment fire; an empty
table gives no rows.

The streaming form keeps one timestamp of state per key (see
``pulsegrid.streaming.jobs.stream_cooldown``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Cooldown of the alert generator.
COOLDOWN_SECONDS = 60.0

_OPEN = -(1 << 63)  # the moment before any alert has fired
_PLAIN_LEVELS = 4  # levels on the way down between two checkpoints


def _stretch_functions(items: DataFrame, keys, c_us: int) -> DataFrame:
    """Steps (keys..., node, upto, after) of every bucket: a moment up to ``upto`` becomes ``after``."""
    return (items.where(F.col("us").isNotNull()).select(*keys, F.col("us").alias("upto")).distinct()
            .select(*keys, F.floor(F.col("upto") / F.lit(c_us)).cast("bigint").alias("node"), "upto",
                    (F.col("upto") + c_us).alias("after")))


def _compose(level: DataFrame, keys) -> DataFrame:
    """Functions of the next level: the values of a left half are looked up among the steps of its right half."""
    left = F.col("_left")
    parent = Window.partitionBy(*keys, "_parent")
    from_here = parent.orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    halves = (level.withColumn("_left", F.col("node") % 2 == 0)
              .withColumn("_parent", F.shiftright("node", 1))
              .withColumn("_at", F.when(left, F.col("after")).otherwise(F.col("upto"))))
    looked = (halves.withColumn("_next", F.last(F.when(~left, F.col("after")), ignorenulls=True).over(from_here))
              .withColumn("_head", F.min(F.when(~left, F.col("upto"))).over(parent))
              .withColumn("_lone", ~F.max(left).over(parent)))
    # a right half alone keeps its steps; behind a left half only its first one can still be met
    steps = (looked.where(left | F.col("_lone") | (F.col("upto") == F.col("_head")))
             .withColumn("after", F.when(left, F.coalesce("_next", "after")).otherwise(F.col("after")))
             .withColumn("_following", F.lead("after").over(parent.orderBy("upto"))))
    return (steps.where(~F.col("after").eqNullSafe(F.col("_following")))
            .select(*keys, F.col("_parent").alias("node"), "upto", "after"))


def _same(a: str, b: str, names) -> F.Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def _descend(entries: DataFrame, level: DataFrame, keys) -> DataFrame:
    """Moments (keys..., node, moment) on entry of each occupied half of the stretches in ``entries``."""
    steps = level.withColumn("_left", F.col("node") % 2 == 0).withColumn("_parent", F.shiftright("node", 1))
    met = F.col("_left") & (F.col("s.upto") >= F.col("e.moment"))
    out = (entries.alias("e").join(steps.withColumnRenamed("node", "_half").withColumnRenamed("_parent", "node").alias("s"),
                                   _same("e", "s", [*keys, "node"]))
           .groupBy(*[F.col(f"e.{k}").alias(k) for k in keys], F.col("e.node").alias("node"), F.col("e.moment").alias("moment"))
           .agg(F.min(F.when(met, F.struct("s.upto", "s.after")))["after"].alias("_after"),
                F.max("_left").alias("_has_left"), F.max(~F.col("_left")).alias("_has_right")))
    half = F.inline(F.array(
        F.struct(F.col("_has_left").alias("_has"), (F.col("node") * 2).alias("_half"), F.col("moment").alias("_m")),
        F.struct(F.col("_has_right").alias("_has"), (F.col("node") * 2 + 1).alias("_half"),
                 F.coalesce("_after", "moment").alias("_m"))))
    return (out.select(*keys, half).where("_has")
            .select(*keys, F.col("_half").alias("node"), F.col("_m").alias("moment")))


def fired_alerts(items: DataFrame, keys, cooldown_seconds: float = COOLDOWN_SECONDS) -> DataFrame:
    """items (keys..., us, id) -> the fired subset (keys..., us, id)."""
    keys = list(keys)
    c_us = int(round(cooldown_seconds * 1_000_000))
    if c_us <= 0:
        return items.where(F.col("us").isNotNull()).groupBy(*keys, "us").agg(F.min("id").alias("id"))
    checkpoint_dir(items.sparkSession)
    levels = [_stretch_functions(items, keys, c_us).checkpoint()]
    low, high = levels[0].agg(F.min("node"), F.max("node")).first()
    if low is None:
        return items.select(*keys, "us", "id").limit(0)
    while low != high:
        levels.append(_compose(levels[-1], keys).checkpoint())
        low, high = low >> 1, high >> 1
        if (low, high) == (-1, 0):
            break  # the two halves of time before and after 1970 never share a stretch
    top = levels[-1]
    entries = top.select(*keys, "node").distinct().withColumn("moment", F.lit(_OPEN).cast("bigint"))
    if low != high:
        first_half = (top.where("node = -1").groupBy(*keys).agg(F.min(F.struct("upto", "after"))["after"].alias("_m")))
        entries = (entries.alias("e").join(first_half.alias("s"), _same("e", "s", keys), "left")
                   .select(*[F.col(f"e.{k}").alias(k) for k in keys], "node",
                           F.when(F.col("node") == 0, F.coalesce("_m", "moment")).otherwise(F.col("moment")).alias("moment")))
    for i, level in enumerate(reversed(levels[:-1]), 1):
        entries = _descend(entries, level, keys)
        if i % _PLAIN_LEVELS == 0:
            entries = entries.checkpoint()
    rows = items.select(*keys, "us", "id").withColumn("node", F.floor(F.col("us") / F.lit(c_us)).cast("bigint"))
    return (entries.alias("e").join(rows.alias("s"), _same("e", "s", [*keys, "node"]))
            .where(F.col("s.us") >= F.col("e.moment"))
            .groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s.node").alias("_node"))
            .agg(F.min(F.struct("s.us", "s.id")).alias("_f"))
            .select(*keys, F.col("_f.us").alias("us"), F.col("_f.id").alias("id")))
