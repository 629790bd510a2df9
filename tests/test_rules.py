import datetime as dt
from decimal import Decimal

from pulsegrid.functions.rules import DEFAULT_RULES, next_above, rules_frame
from pulsegrid.operators import detect


def test_float_threshold_boundaries_are_exact_decimals():
    er, p99, conn = DEFAULT_RULES
    assert er.warn_from == Decimal("0.150") and er.critical_from == Decimal("0.300")
    assert p99.warn_from == Decimal("800.1") and p99.critical_from == Decimal("1600.1")
    assert conn.warn_from == Decimal("19") and conn.critical_from == Decimal("37")


def test_next_above_is_strict():
    assert next_above(0.25, 2) == Decimal("0.26")  # 0.25 is exact in binary
    assert next_above(0.1, 1) == Decimal("0.2")  # float 0.1 lies above 0.1


METRICS = ("id long, org_id string, service string, ts timestamp, error_rate decimal(5,3), p99_latency_ms decimal(8,1), "
           "active_connections int, rss_mb decimal(8,1)")


def _rows(df):
    return sorted((r["src_id"], r["metric"], r["value"], r["severity"], r["sub"]) for r in df.collect())


def test_rules_as_rows(spark):
    at = dt.datetime(2026, 7, 22)
    m = spark.createDataFrame([
        (i, "o", "s", at, Decimal(i % 7) / 20, None if i % 5 == 0 else Decimal(i * 100) + Decimal("0.1"), i, Decimal(i))
        for i in range(60)] + [(1, "o", "s", at, Decimal("0.150"), Decimal("800.1"), 19, None)], METRICS)
    rules = rules_frame(spark)
    assert _rows(detect.detect_by_rules(m, rules)) == _rows(detect.detect_metric_breaches(m))
    row = [(7, "rss_mb", Decimal("50"), None), (8, "no_such_column", Decimal("1"), None), (9, "rss_mb", None, None)]
    more = rules.unionByName(spark.createDataFrame(row, rules.schema))
    added = [r for r in _rows(detect.detect_by_rules(m, more)) if r not in _rows(detect.detect_by_rules(m, rules))]
    assert added == [(i, "rss_mb", float(i), "warning", 7) for i in range(50, 60)]
    assert detect.detect_by_rules(m, rules.limit(0)).collect() == []
    assert detect.detect_by_rules(m.limit(0), rules).collect() == []
