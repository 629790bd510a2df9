"""Threshold rules and their exact decimal boundaries.

A rule compares a DECIMAL column against a binary float threshold. Compared
exactly, ``Decimal('0.150') > 0.15`` is true because the float 0.15 lies just
below 0.150; Spark and DuckDB would cast the decimal to double and say false.
So each rule is turned into the smallest decimal at the column's scale that
lies strictly above the float (``warn_from``), and the same for twice the
threshold (``critical_from``); the comparison is then an exact ``>=`` on
decimals, identical in every engine.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default thresholds (metric column, threshold, column scale).
ERROR_RATE_THRESHOLD = 0.15
LATENCY_THRESHOLD_MS = 800.0
CONNECTIONS_THRESHOLD = 18.0
RSS_TREND_SLOPE_MB_PER_MIN = 5.0
RSS_TREND_MIN_MB = 200.0
GROUPING_WINDOW_SECONDS = 10.0
SIMILARITY_THRESHOLD = 0.86
RECURRENCE_LOOKBACK_SECONDS = 3600.0
CASE_CONTEXT_PADDING_SECONDS = 30.0
ACTION_MATCH_TOP_K = 3
DEDUP_TOP_K = 5


def next_above(threshold: float, scale: int) -> Decimal:
    """Smallest decimal with ``scale`` digits that is strictly greater than the float."""
    exact = Decimal(threshold)  # exact binary value of the float
    step = Decimal(1).scaleb(-scale)
    floored = (exact / step).to_integral_value(rounding=ROUND_FLOOR)
    return (floored + 1) * step


@dataclass(frozen=True)
class Rule:
    metric: str
    threshold: float
    scale: int

    @property
    def warn_from(self) -> Decimal:
        return next_above(self.threshold, self.scale)

    @property
    def critical_from(self) -> Decimal:
        return next_above(self.threshold * 2, self.scale)


DEFAULT_RULES = (
    Rule("error_rate", ERROR_RATE_THRESHOLD, 3),
    Rule("p99_latency_ms", LATENCY_THRESHOLD_MS, 1),
    Rule("active_connections", CONNECTIONS_THRESHOLD, 0),
)


RULE_BOUND = "decimal(38,6)"


def rules_frame(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    """Rules as rows, numbered in their order, with exact bounds; users append rows of their own."""
    rows = [(i, r.metric, r.warn_from, r.critical_from) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, f"rule_id int, metric string, warn_from {RULE_BOUND}, critical_from {RULE_BOUND}")


def severity(value: Column, rule: Rule) -> Column:
    """``critical`` if value > 2*threshold (exactly), else ``warning``."""
    crit = F.lit(rule.critical_from).cast(f"decimal(38,{rule.scale})")
    return F.when(value >= crit, F.lit("critical")).otherwise(F.lit("warning"))


def breached(value: Column, rule: Rule) -> Column:
    warn = F.lit(rule.warn_from).cast(f"decimal(38,{rule.scale})")
    return value.isNotNull() & (value >= warn)
