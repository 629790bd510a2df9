"""Batch and stream give the same sessions when the stream runs in several micro-batches."""

from pyspark.sql import functions as F

from pulsegrid.operators import detect, sessionize, signature
from pulsegrid.sources import views
from pulsegrid.streaming import jobs, ticks

SF = "/root/testdata/sf0.001"


def test_stream_sessions_equal_batch(spark):
    src = ticks.split_by_day(spark, SF, jobs.run_folder(spark, "t-input"), days=10)
    jobs.end_of_input_marker(spark, src)  # last file of the source closes the replay
    stream = jobs.stream_breach_sessions(spark, src, 1800.0, watermark="2 hours", max_files_per_trigger=1,
                                         glob="*.parquet")
    b = detect.detect_metric_breaches(views.metrics_v(spark, SF)).select(*detect.BREACH_COLUMNS).unionByName(
        detect.detect_error_logs(views.logs_v(spark, SF)).select(*detect.BREACH_COLUMNS))
    g = signature.group_signatures(sessionize.sessionize(b, ["org_id", "service"], 1800.0,
                                                         order_cols=["seq", "src_id", "sub"]))
    want = {(r["org_id"], r["service"], r["first_ts"], r["last_ts"], r["n_breaches"]) for r in g.collect()}
    got = {(r["org_id"], r["service"], r["first_ts"], r["last_ts"], r["n_breaches"]) for r in stream.collect()}
    assert got == want
    assert stream.where(F.col("org_id") == jobs.MARKER_ORG).count() == 0


def test_stream_trend_equals_batch_over_several_batches(spark):
    src = ticks.split_by_day(spark, SF, jobs.run_folder(spark, "t-trend"), days=10)
    jobs.end_of_input_marker(spark, src)
    trend = {"window_seconds": 172800.0, "slide_seconds": 21600.0, "slope_mb_per_min": -1000.0, "min_mb": 0.0}  # all windows
    got = jobs.stream_detect(spark, src, trend, watermark="2 hours", max_files_per_trigger=1, glob="*.parquet")
    want = detect.all_breaches(views.metrics_v(spark, SF), views.logs_v(spark, SF), trend_window="48 hours",
                               trend_slide="6 hours", slope_mb_per_min=-1000.0, min_mb=0.0)
    columns = ["org_id", "service", "metric", "ts", "seq", "src_id", "sub", "value"]
    got, want = (sorted(tuple(r) for r in df.select(*columns).collect()) for df in (got, want))
    assert got == want and sum(r[2] == "rss_mb" for r in got) > 50
