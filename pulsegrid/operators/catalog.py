"""Service catalog: apps and services seen so far, with the time something new last appeared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def service_catalog(seen: DataFrame, app_col: str = "app", service_col: str = "service") -> DataFrame:
    """One row: sorted distinct apps and services; ``last_updated`` moves only when a new value appears.

    Empty strings count as missing. Each value's first sighting is a bounded
    per-value aggregate; the catalog is the union of those (vocabulary-sized).
    """
    pairs = F.array(F.struct(F.lit("app").alias("kind"), F.col(app_col).alias("value")),
                    F.struct(F.lit("service").alias("kind"), F.col(service_col).alias("value")))
    both = (seen.select("ts", F.explode(pairs).alias("p"))  # one pass over the input
            .where(F.col("p.value").isNotNull() & (F.col("p.value") != ""))
            .groupBy(F.col("p.kind").alias("kind"), F.col("p.value").alias("value"))
            .agg(F.min("ts").alias("first_seen")))
    return both.agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "app", F.col("value")))).alias("apps"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "service", F.col("value")))).alias("services"),
        F.max("first_seen").alias("last_updated"),
    )
