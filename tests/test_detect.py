import datetime as dt
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.operators import detect, sessionize, signature

T0 = dt.datetime(2026, 7, 22, 11, 22, 0)
METRIC_SCHEMA = ("id bigint, ts timestamp, service string, error_rate decimal(5,3), p99_latency_ms decimal(8,1), "
                 "active_connections int, rss_mb decimal(8,1), org_id string")


def _metrics(spark, rows):
    return spark.createDataFrame(rows, METRIC_SCHEMA)


def test_threshold_edges(spark):
    rows = []
    for i, v in enumerate(["0.149", "0.150", "0.300", "0.301", None]):
        rows.append((i, T0, "s", Decimal(v) if v else None, None, None, None, "o"))
    for i, v in enumerate(["800.0", "800.1", "1600.0", "1600.1"]):
        rows.append((10 + i, T0, "s", None, Decimal(v), None, None, "o"))
    for i, v in enumerate([18, 19, 36, 37]):
        rows.append((20 + i, T0, "s", None, None, v, None, "o"))
    out = {r["src_id"]: r["severity"] for r in detect.detect_metric_breaches(_metrics(spark, rows)).collect()}
    assert out == {1: "warning", 2: "critical", 3: "critical", 11: "warning", 12: "warning", 13: "critical",
                   21: "warning", 22: "warning", 23: "critical"}


def test_trend_breach_and_halves(spark):
    vals = [200, 200, 210, 220, 230]
    rows = [(i, T0 + dt.timedelta(seconds=15 * i), "s", None, None, None, Decimal(v), "o") for i, v in enumerate(vals)]
    out = detect.detect_rss_trend(_metrics(spark, rows), bucket_seconds=20).collect()
    assert len(out) == 1
    assert abs(out[0]["value"] - 20.0) < 1e-9  # (220 - 200) / 1 minute, odd row in the second half
    assert out[0]["ts"] == T0 + dt.timedelta(seconds=60)
    assert detect.detect_rss_trend(_metrics(spark, rows[:3])).count() == 0
    same_ts = [(i, T0, "s", None, None, None, Decimal(200 + 50 * i), "o") for i in range(5)]
    assert detect.detect_rss_trend(_metrics(spark, same_ts)).count() == 0


def _breach_rows(spark, offsets_s, key="s"):
    rows = [("o", key, "log_error", 1.0, T0 + dt.timedelta(microseconds=int(o * 1e6)), "critical", "e", f"m{i}",
             None, 2, i, 0) for i, o in enumerate(offsets_s)]
    return spark.createDataFrame(rows, "org_id string, service string, metric string, value double, ts timestamp, "
                                       "severity string, event string, message string, trace_id string, seq int, "
                                       "src_id bigint, sub int")


def test_gap_is_inclusive(spark):
    b = _breach_rows(spark, [0, 10, 20.001])
    g = sessionize.sessionize(b, ["org_id", "service"], 10, order_cols=["seq", "src_id", "sub"], bucket_seconds=7)
    starts = {r["src_id"]: r["group_start"] for r in g.collect()}
    assert starts[0] == starts[1] == T0 and starts[2] == T0 + dt.timedelta(seconds=20.001)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=400), min_size=1, max_size=40),
       st.sampled_from([3, 7, 30]), st.sampled_from([5, 10]))
def test_two_level_equals_plain(spark, offsets, bucket, gap):
    b = _breach_rows(spark, sorted(offsets))
    two = sessionize.sessionize(b, ["org_id", "service"], gap, order_cols=["seq", "src_id", "sub"],
                                bucket_seconds=bucket)
    one = sessionize.sessionize_plain(b, ["org_id", "service"], gap, order_cols=["seq", "src_id", "sub"])
    a = sorted((r["src_id"], r["group_start"]) for r in two.collect())
    c = sorted((r["src_id"], r["group_start"]) for r in one.collect())
    assert a == c


def test_signature_text(spark):
    b = _breach_rows(spark, [0, 1, 2, 3])
    b = b.withColumn("message", F.when(F.col("src_id") < 2, "Timeout calling card processor")
                     .otherwise(F.lit("")))
    b = b.withColumn("event", F.lit("payment_gateway_timeout")).withColumn("service", F.lit("payments-service"))
    g = sessionize.sessionize(b, ["org_id", "service"], 10, order_cols=["seq", "src_id", "sub"])
    sig = signature.group_signatures(g).collect()[0]["signature_text"]
    assert sig == ('service=payments-service; metrics=[log_error]; events=[payment_gateway_timeout]; '
                   'severity=critical; sample_messages="Timeout calling card processor"')


def test_trend_does_not_depend_on_the_order_of_rows(spark):
    vals = [Decimal(v) / 10 for v in (2001, 2013, 2107, 2299, 2301, 2403, 2507, 2611, 2703)]
    rows = [(i, T0 + dt.timedelta(seconds=15 * i), "s", None, None, None, v, "o") for i, v in enumerate(vals)]
    mean = [float(sum(vals[:4])) / 4, float(sum(vals[4:])) / 5]
    for k in range(4):
        got = detect.detect_rss_trend(_metrics(spark, rows[k:] + rows[:k]).repartition(k + 1), bucket_seconds=20).collect()
        assert [r["value"] for r in got] == [(mean[1] - mean[0]) / 2.0]


SESSIONS = st.lists(st.tuples(st.integers(0, 300), st.sampled_from(["critical", "warning"]), st.sampled_from(["a", "b", "c", "", None]),
                              st.sampled_from(["error_rate", "rss_mb"]), st.sampled_from(["e1", "", None])),
                    min_size=1, max_size=40)


@settings(max_examples=12, deadline=None)
@given(SESSIONS, st.sampled_from([1.0, 10.0, 45.0]))
def test_one_pass_rollup_equals_grouping_first(spark, rows, gap):
    """Sessions over many buckets: summaries merge to what the rows of each group give."""
    data = [("o", "st"[i % 2], metric, 1.0, T0 + dt.timedelta(seconds=at), severity, event, message, None, 2, i, 0)
            for i, (at, severity, message, metric, event) in enumerate(rows)]
    b = spark.createDataFrame(data, "org_id string, service string, metric string, value double, ts timestamp, "
                                    "severity string, event string, message string, trace_id string, seq int, "
                                    "src_id bigint, sub int")
    grouped = sessionize.sessionize_plain(b, ["org_id", "service"], gap, order_cols=["seq", "src_id", "sub"])
    columns = ["org_id", "service", "group_start", "first_ts", "last_ts", "n_breaches", "severity", "metrics", "events"]
    want = signature.group_signatures(grouped).select(*columns, "signature_text").collect()
    one_pass = sessionize.session_rollup(b, ["org_id", "service"], gap, bucket_seconds=7)
    got = one_pass.withColumn("signature_text", signature.signature_text(
        F.col("service"), F.col("metrics"), F.col("events"), F.col("severity"), F.col("samples"))).select(*columns, "signature_text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
