"""Tenant-scoped read models: recent rows, lookups by id, lists.

Optional arguments become predicates only when given (``col = value``), so
the filter reaches the parquet scan and no ``value IS NULL OR ...`` residue
is left. Newest-first reads are ``orderBy(...).limit(n)``, which Spark plans as
a TakeOrderedAndProject (per-partition top-n, then a merge) rather than a
full sort. Every order carries a unique tie-break so results are stable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 100


def optional_eq(df: DataFrame, **equals) -> DataFrame:
    for col, value in equals.items():
        if value is not None:
            df = df.where(F.col(col) == F.lit(value))
    return df


def effective_limit(limit: int | None) -> int:
    return DEFAULT_LIMIT if limit is None or limit <= 0 else int(limit)


def recent(df: DataFrame, ts_col: str = "ts", id_col: str = "id", limit: int | None = DEFAULT_LIMIT,
           **equals) -> DataFrame:
    """Newest first; Postgres puts NULL timestamps first in DESC order, so do we."""
    df = optional_eq(df, **equals)
    return df.orderBy(F.col(ts_col).desc_nulls_first(), F.col(id_col).desc()).limit(effective_limit(limit))


def by_id(df: DataFrame, id_col: str, value, org_id: str | None = None, org_col: str = "org_id") -> DataFrame:
    df = df.where(F.col(id_col) == F.lit(value))
    if org_id is not None:
        df = df.where(F.col(org_col) == F.lit(org_id))
    return df


def trace_by_id(traces: DataFrame, trace_id: str, org_id: str | None = None) -> DataFrame:
    return by_id(traces, "trace_id", trace_id, org_id).orderBy("ts", "id")


def open_cases_with_alerts(cases: DataFrame, alerts: DataFrame, limit: int = 5, service: str | None = None,
                           org_id: str | None = None) -> DataFrame:
    """Not-resolved cases, last opened first, each with its alerts nested (``[]`` when none).

    The top-n cases are picked first and only their alerts are joined, so the
    alert side is filtered by a small semi-join instead of grouped whole.
    """
    c = optional_eq(cases.where(F.col("status") != "RESOLVED"), primary_service=service, org_id=org_id)
    top = c.orderBy(F.col("opened_at").desc_nulls_first(), F.col("id").desc()).limit(limit)
    a = alerts.join(top.select(F.col("id").alias("case_id")), "case_id", "left_semi")
    nested = a.groupBy("case_id").agg(F.array_sort(F.collect_list(
        F.struct(F.col("triggered_at"), F.col("id").alias("alert_id"), "service", "metric", "severity"))).alias("alerts"))
    out = top.join(nested, top.id == nested.case_id, "left").drop("case_id")
    return out.withColumn("alerts", F.coalesce("alerts", F.array()))
