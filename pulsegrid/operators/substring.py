"""Exact substring join: which lines of a time interval hold a given text anywhere.

A line that holds a text holds all its q-grams, so one of them is enough to meet: each text is looked
up by its rarest one. Q-grams are counted in a fixed number of slots, over all lines of the time span
that is asked for, with map-side sums; the slots in use are the only thing that is broadcast, at most
``SLOTS`` rows however many texts or lines there are. Lines leave the scan only with slots that are
the rarest of some text, meet on (keys, time bucket, slot), and are verified with ``contains``.
A text that has a q-gram of an empty slot is in no line. Texts shorter than a q-gram have slot -1,
which every line has, and meet on (keys, time bucket) alone.

Defined results: a null text or line matches nothing, an empty text is in every line; repeated lines
and texts are matched each; both ends of an interval count; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

Q = 4
SLOTS = 1 << 16
_SHORT = -1


def gram_slots(text: Column, q: int = Q) -> Column:
    """Distinct slots of the q-grams of a text (none if it is shorter)."""
    n = F.char_length(text)
    starts = F.when(n >= q, F.sequence(F.lit(1), n - (q - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(q))), F.lit(SLOTS))
                                        .cast("int")))


def _bucket(ts: Column, bucket_us: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(bucket_us)).cast("bigint")


def contains_join(needles: DataFrame, lines: DataFrame, keys, start: Column, end: Column, needle: str = "needle",
                  text: str = "line", ts: str = "ts", bucket_seconds: float = 300.0) -> DataFrame:
    """Rows of ``needles`` and ``lines`` with equal ``keys``, ``start <= ts <= end``, and the needle in the text.

    Columns of the two sides other than ``keys`` have different names. Needles are written to the shared
    checkpoint folder once, with the slot by which they are looked up.
    """
    keys, bus = list(keys), int(bucket_seconds * 1_000_000)
    checkpoint_dir(needles.sparkSession)
    wanted = (needles.where(F.col(needle).isNotNull()).withColumn("_from", start).withColumn("_to", end)
              .withColumn("_nid", F.monotonically_increasing_id()).checkpoint())
    first, last = wanted.agg(F.min(F.unix_micros("_from")), F.max(F.unix_micros("_to"))).first()
    span = lines.where(F.col(text).isNotNull())
    span = span.where(F.lit(False)) if first is None else span.where(
        F.col(ts).between(F.timestamp_micros(F.lit(first)), F.timestamp_micros(F.lit(last))))

    grams = wanted.select("_nid", F.explode(gram_slots(F.col(needle))).alias("_slot"))
    asked = F.broadcast(grams.select("_slot").distinct())  # at most SLOTS rows
    counted = (span.select(F.explode(gram_slots(F.col(text))).alias("_slot")).join(asked, "_slot", "left_semi")
               .groupBy("_slot").agg(F.count(F.lit(1)).alias("_n")))
    rarest = (grams.join(F.broadcast(counted), "_slot", "left").groupBy("_nid")  # at most SLOTS rows
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_slot")).alias("_r")))
    found = (wanted.join(rarest, "_nid", "left").where(F.col("_r").isNull() | (F.col("_r.n") > 0))
             .withColumn("_slot", F.coalesce("_r._slot", F.lit(_SHORT))).drop("_r", "_nid").checkpoint())

    met = F.broadcast(found.select(F.col("_slot").alias("_met")).distinct())  # at most SLOTS + 1 rows
    probes = (span.withColumn("_slot", F.explode(F.array_append(gram_slots(F.col(text)), F.lit(_SHORT))))
              .join(met, F.col("_slot") == F.col("_met"), "left_semi").withColumn("_b", _bucket(F.col(ts), bus)))
    asks = found.withColumn("_b", F.explode(F.sequence(_bucket(F.col("_from"), bus), _bucket(F.col("_to"), bus))))
    return (asks.join(probes, [*keys, "_b", "_slot"])
            .where(F.col(ts).between(F.col("_from"), F.col("_to")) & F.col(text).contains(F.col(needle)))
            .drop("_b", "_slot", "_from", "_to"))
