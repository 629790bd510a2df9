"""Wire log lines to log rows (level, service, message, key=value context, trace_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse


def parse_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Adds level, service, message, context (map or NULL) and trace_id; drops unparseable lines."""
    pieces = parse.split_pieces(F.col(line_col))
    out = (df.withColumn("_pieces", pieces)
           .where(parse.head_match(F.try_element_at(F.col("_pieces"), F.lit(1))))
           .withColumn("_head", parse.head_groups(F.try_element_at(F.col("_pieces"), F.lit(1))))
           .withColumn("context", parse.context_map(F.col("_pieces")))
           .withColumns({"level": F.col("_head")[0], "service": F.col("_head")[2], "message": F.col("_head")[1],
                         "trace_id": F.col("context")["trace_id"]})
           .drop("_pieces", "_head"))
    return out


def context_pairs(df: DataFrame, line_col: str = "line", id_col: str = "line_id") -> DataFrame:
    """One row per (line, key) with the last value of that key."""
    pieces = parse.split_pieces(F.col(line_col))
    return (df.where(parse.head_match(F.try_element_at(pieces, F.lit(1))))
            .select(id_col, F.posexplode(parse.context_entries(pieces)).alias("pos", "e"))
            .select(id_col, "pos", F.col("e.key").alias("key"), F.col("e.value").alias("value")))
