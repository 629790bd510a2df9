"""Log-count dashboards: totals, per-interval level breakdown, volume by source.

Line filters follow the dashboard semantics: ``|= "x"`` is a case-sensitive
substring test, ``|~ "a|b"`` an unanchored regex, label selectors ``=~`` are
anchored. ``by="substring"`` reproduces the dashboard (an INFO line that
mentions ERROR counts for both); ``by="level"`` counts the parsed level once.
All counts are conditional aggregates in one pass (``count_if``), partially
aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("INFO", "WARN", "ERROR", "CRITICAL")


def line_contains(line: Column, text: str) -> Column:
    return line.contains(text)


def line_regex(line: Column, pattern: str) -> Column:
    return line.rlike(pattern)


def label_regex(label: Column, pattern: str) -> Column:
    return label.rlike(f"^(?:{pattern})$")


def _has(level: str, by: str) -> Column:
    if by == "level":
        return F.col("level") == level
    return F.col("line").contains(level)


def log_totals(lines: DataFrame, by: str = "substring") -> DataFrame:
    err = (F.col("level").isin("ERROR", "CRITICAL") if by == "level"
           else F.col("line").rlike("ERROR|CRITICAL"))
    return lines.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_has("WARN", by)).alias("warn"),
        F.count_if(err).alias("error_or_critical"),
    )


def level_series(lines: DataFrame, interval: str = "1 minute", by: str = "substring") -> DataFrame:
    return (lines.groupBy(F.window("ts", interval).alias("w"))
            .agg(*[F.count_if(_has(lv, by)).alias(lv.lower()) for lv in LEVELS])
            .select(F.col("w.start").alias("bucket_start"), *[lv.lower() for lv in LEVELS]))


def volume_series(lines: DataFrame, interval: str = "1 minute", source_col: str = "filename") -> DataFrame:
    return (lines.groupBy(source_col, F.window("ts", interval).alias("w")).count()
            .select(source_col, F.col("w.start").alias("bucket_start"), F.col("count").alias("lines")))


def latest_errors(lines: DataFrame, limit: int = 100, pattern: str = "ERROR|CRITICAL",
                  id_col: str = "line_id") -> DataFrame:
    return (lines.where(F.col("line").rlike(pattern))
            .orderBy(F.col("ts").desc(), F.col(id_col).desc()).limit(limit))


def table_counts(**tables: DataFrame) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
