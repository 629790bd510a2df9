import datetime as dt

from pyspark.sql import functions as F

from pulsegrid.sources import ingest

T0 = dt.datetime(2026, 7, 22, 11, 0, 0)


def test_batch_is_all_or_nothing(spark):
    good = '[{"service":"s","level":"INFO","event":"e"},{"service":"s","level":"WARN","event":"e"}]'
    one_bad = '[{"service":"s","level":"INFO","event":"e"},{"level":"WARN","event":"e"}]'
    broken = '[{"service":"s",'
    bodies = spark.createDataFrame([(1, good, T0), (2, one_bad, T0), (3, broken, T0)],
                                   "batch long, body string, received_at timestamp")
    out = ingest.parse_bodies(bodies, ingest.LOG_ENTRY)
    assert sorted((r["batch"], r["pos"]) for r in out.collect()) == [(1, 0), (1, 1)]


def test_guard_refuses_oversized_batches(spark):
    rows = spark.range(7).select((F.col("id") % 2).alias("batch"), F.col("id"))
    g = {r["batch"]: (r["n_rows"], r["accepted"]) for r in ingest.batch_guard(rows, ["batch"], cap=3).collect()}
    assert g == {0: (4, False), 1: (3, True)}


def test_rows_sent_are_rows_accepted_plus_rows_refused(spark):
    rows = spark.range(12_345).select(
        F.lit("org-1").alias("org"), F.col("id"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id") % 20_000)).alias("ts"),
        F.when(F.col("id") != 77, F.lit("s")).alias("service"))
    numbered = ingest.number_bodies(rows, ["org"], "id")
    sizes = {r["body_no"]: r["count"] for r in numbered.groupBy("body_no").count().collect()}
    assert sizes == {0: 5000, 1: 5000, 2: 2345}
    entry = F.struct("service", F.lit("INFO").alias("level"), F.lit("e").alias("event"))
    bodies = ingest.build_bodies(numbered, ["org", "body_no"], entry)
    accepted, refused = ingest.parse_bodies(bodies, ingest.LOG_ENTRY), ingest.refused_bodies(bodies, ingest.LOG_ENTRY)
    bad = refused.collect()
    assert [(r["body_no"], r["reason"], r["n_rows"]) for r in bad] == [(0, "missing_field", 5000)]
    assert accepted.count() + sum(r["n_rows"] for r in bad) == 12_345
    whole = ingest.build_bodies(numbered.withColumn("n", F.col("body_no") * 5000 + F.col("body_pos")), ["org"], entry, "n")
    assert [(r["reason"], r["n_rows"]) for r in ingest.refused_bodies(whole, ingest.LOG_ENTRY).collect()] == \
        [("too_many_rows", 12_345)]
