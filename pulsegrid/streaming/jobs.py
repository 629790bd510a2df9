"""Structured Streaming jobs: detection, breach sessions, cooldown, chained case stages.

Sources are file streams with an explicit schema; event time is cast from
TIMESTAMP_NTZ to TIMESTAMP (session zone UTC) before watermarking. Sinks
are ``foreachBatch`` writers that overwrite a ``batch=<id>`` folder, so a
retried micro-batch replaces its own output (exactly-once per batch id).
Checkpoints and outputs live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import detect
from ..session import checkpoint_dir, prepare
from ..sources import views

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def events_stream(spark: SparkSession, src_dir: str, glob: str = "events.parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    prepare(spark)
    r = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(src_dir)


def stream_breaches(events: DataFrame) -> DataFrame:
    """Threshold and error-log breaches of a stream, which need no state (the trend is ``stream_trend``)."""
    parts = [detect.detect_metric_breaches(views.metrics_from(events)),
             detect.detect_error_logs(views.logs_from(events))]
    return parts[0].select(*detect.BREACH_COLUMNS).unionByName(parts[1].select(*detect.BREACH_COLUMNS))


def breach_sessions(breaches: DataFrame, gap_seconds: float, watermark: str = "1 hour") -> DataFrame:
    """Event-time session windows per (org, service); a gap equal to ``gap_seconds`` stays in the session."""
    gap = f"{int(round(gap_seconds * 1_000_000))} microseconds"
    return (breaches.withWatermark("ts", watermark)
            .groupBy("org_id", "service", F.session_window("ts", gap).alias("sw"))
            .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                 F.count(F.lit(1)).alias("n_breaches"),
                 F.max(F.when(F.col("severity") == "critical", 1).otherwise(0)).alias("crit"),
                 F.array_sort(F.collect_set("metric")).alias("metrics"))
            .select("org_id", "service", "first_ts", "last_ts", "n_breaches",
                    F.when(F.col("crit") == 1, "critical").otherwise("warning").alias("severity"), "metrics"))


def _batch_writer(out_dir: str):
    def write(df: DataFrame, batch_id: int):
        df.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
    return write


def run_available(df: DataFrame, out_dir: str, ckpt: str, mode: str = "append",
                  processing_time: str | None = None) -> None:
    """Run a streaming query over everything available now (or on a fixed interval) into ``out_dir``."""
    w = (df.writeStream.foreachBatch(_batch_writer(out_dir)).outputMode(mode)
         .option("checkpointLocation", ckpt))
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    q = w.start()
    q.awaitTermination()


def read_batches(spark: SparkSession, out_dir: str, schema: str | None = None) -> DataFrame:
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.parquet(out_dir)


class TrendProcessor(StatefulProcessor):
    """Per key: memory values by slide bucket with their running sums; a timer at each window's end.

    When the watermark passes the end of a window, its halves are added up from the sums of whole buckets
    and the values of the one bucket that the middle falls into, the trend is emitted if it is a breach,
    and the window's first bucket, which no later window holds, is evicted. So the state of a key is the
    values of one window and the watermark's delay. Values are whole thousandths: sums are exact.
    """

    slide_us, per_window = 10_000_000, 12
    slope_mb_per_min = min_mb = 0.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "bucket long", "total long, us array<long>, id array<long>, v array<long>")

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            pdf = pdf[pdf["v"].notna()]
            for b, part in pdf.groupby(pdf["us"] // self.slide_us):
                b, new = int(b), [[int(x) for x in part[c]] for c in ("us", "id", "v")]
                total, old = sum(new[2]), self.buckets.getValue((b,))
                if old is not None:
                    total += int(old[0])
                    new = [[*(int(x) for x in o), *n] for o, n in zip(old[1:], new, strict=True)]
                else:
                    for later in range(1, self.per_window + 1):  # windows with this bucket end here
                        self.handle.registerTimer((b + later) * self.slide_us // 1000)
                self.buckets.updateValue((b,), (total, *new))
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.slide_us
        held = [self.buckets.getValue((b,)) for b in range(end - self.per_window, end)]
        found = self._trend([b for b in held if b is not None])
        if held[0] is not None:
            self.buckets.removeKey((end - self.per_window,))
        yield self._rows(key, found)

    def _trend(self, buckets: list[tuple]) -> list[tuple[float, int]]:
        n = sum(len(b[1]) for b in buckets)
        if n < 4:
            return []
        first, last, middle = int(min(buckets[0][1])), int(max(buckets[-1][1])), n // 2
        if last <= first:
            return []
        whole, early, before = sum(int(b[0]) for b in buckets), 0, 0
        for total, us, ids, values in buckets:
            if before + len(us) <= middle:
                early += int(total)
            elif before < middle:
                ranked = sorted(zip(map(int, us), map(int, ids), map(int, values)))
                early += sum(v for _, _, v in ranked[:middle - before])
            before += len(us)
        means = early / 1000 / middle, (whole - early) / 1000 / (n - middle)
        slope = (means[1] - means[0]) / ((last - first) / 60_000_000.0)
        return [(slope, last)] if slope >= self.slope_mb_per_min and means[1] >= self.min_mb else []

    @staticmethod
    def _rows(key, found: list[tuple[float, int]]) -> pd.DataFrame:
        names = [pd.Series([k] * len(found), dtype="object") for k in key]
        return pd.DataFrame({"org_id": names[0], "service": names[1],
                             "value": pd.Series([f[0] for f in found], dtype="float64"),
                             "us": pd.Series([f[1] for f in found], dtype="int64")})

    def close(self) -> None:
        pass


def stream_trend(metrics: DataFrame, window_seconds: float, slide_seconds: float, slope_mb_per_min: float, min_mb: float,
                 watermark: str = "1 hour") -> DataFrame:
    """D5 on a stream: the trailing memory trend of each (org, service) at every slide, in breach columns.

    A window is judged once the watermark has passed its end; equal to ``detect_rss_trend_sliding`` over
    the same rows. The window must be a multiple of the slide, the slide whole milliseconds.
    """
    slide = int(round(slide_seconds * 1_000_000))
    of_window = int(round(window_seconds * 1_000_000)) // slide

    class Proc(TrendProcessor):
        slide_us, per_window = slide, of_window

    Proc.slope_mb_per_min, Proc.min_mb = slope_mb_per_min, min_mb
    rows = metrics.withWatermark("ts", watermark).select(
        "org_id", "service", "ts", F.unix_micros("ts").alias("us"), "id", (F.col("rss_mb") * 1000).cast("bigint").alias("v"))
    found = rows.groupBy("org_id", "service").transformWithStateInPandas(
        statefulProcessor=Proc(), outputStructType="org_id string, service string, value double, us long",
        outputMode="Append", timeMode="EventTime")
    none = F.lit(None).cast("string")
    return found.select("org_id", "service", F.lit("rss_mb").alias("metric"), "value", F.timestamp_micros("us").alias("ts"),
                        F.lit("warning").alias("severity"), none.alias("event"), none.alias("message"),
                        none.alias("trace_id"), F.lit(detect.SEQ_TREND).alias("seq"),
                        F.lit(-1).cast("bigint").alias("src_id"), F.lit(0).alias("sub"))


def stream_detect(spark: SparkSession, src_dir: str, trend: dict | None = None, watermark: str = "1 hour",
                  max_files_per_trigger: int | None = None, close: bool = True, glob: str = "events.parquet") -> DataFrame:
    """T-1: breaches of all three detectors, micro-batch by micro-batch; returns the sink contents.

    ``trend`` holds the arguments of ``stream_trend`` besides metrics and watermark (None: no trend).
    ``close`` and multi-batch replays are as in ``stream_breach_sessions``.
    """
    out, ck = run_folder(spark, "detect-out"), run_folder(spark, "detect-ckpt")
    ev = events_stream(spark, src_dir, glob=glob, max_files_per_trigger=max_files_per_trigger)
    if close and not max_files_per_trigger:
        ev = ev.unionByName(events_stream(spark, end_of_input_marker(spark), glob="*.parquet"))
    found = stream_breaches(ev)
    if trend is not None:
        found = found.unionByName(stream_trend(views.metrics_from(ev), watermark=watermark, **trend))
    _with_rocksdb(spark, lambda: run_available(found, out, ck))
    return read_batches(spark, out).drop("batch", "_batch").where(F.col("org_id") != MARKER_ORG)


def _with_rocksdb(spark: SparkSession, work) -> None:
    """Runs a query whose state needs the RocksDB store."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        work()
    finally:
        spark.conf.set(PROVIDER, before)


def end_of_input_marker(spark: SparkSession, path: str | None = None) -> str:
    """Folder with one control event far in the future (an ``error`` of tenant ``org--1``).

    Append-mode session windows are emitted only once the watermark passes
    their end, so the last session of a bounded replay would stay in state.
    Streaming this marker after the data moves the watermark past every real
    session; its own breach is filtered out by tenant.
    """
    path = path or run_folder(spark, "eoi")
    row = [(-1, "2200-01-01 00:00:00", -1, "error", 0.0, "{}")]
    (spark.createDataFrame(row, "event_id long, ts string, user_id long, event_type string, value double, "
                                "props string")
     .select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
     .write.mode("append").parquet(path))
    return path


MARKER_ORG = "org--1"


def stream_breach_sessions(spark: SparkSession, src_dir: str, gap_seconds: float, watermark: str = "1 hour",
                           max_files_per_trigger: int | None = None, close: bool = True,
                           glob: str = "events.parquet") -> DataFrame:
    """G5: event-time session windows in append mode (a session is final once the watermark passes it).

    With ``close`` an end-of-input marker is streamed with the data so every
    real session is emitted by the end of a bounded single-batch replay. For
    multi-batch replays (``max_files_per_trigger``) the marker must be the last
    file of the source itself (``end_of_input_marker(spark, src_dir)``), so
    ``close`` is ignored there.
    """
    out, ck = run_folder(spark, "sessions-out"), run_folder(spark, "sessions-ckpt")
    ev = events_stream(spark, src_dir, glob=glob, max_files_per_trigger=max_files_per_trigger)
    if close and not max_files_per_trigger:
        ev = ev.unionByName(events_stream(spark, end_of_input_marker(spark), glob="*.parquet"))
    run_available(breach_sessions(stream_breaches(ev), gap_seconds, watermark), out, ck, mode="append")
    return read_batches(spark, out).drop("batch", "_batch").where(F.col("org_id") != MARKER_ORG)


class CooldownProcessor(StatefulProcessor):
    """Per key: fire when at least ``cooldown_us`` has passed since the last fired alert (one value of state)."""

    cooldown_us = 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_fired", "us long")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        fired = []
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["us", "id"], kind="stable")
        for us, rid in zip(pdf["us"].tolist(), pdf["id"].tolist()):
            if last is None or us - last >= self.cooldown_us:
                fired.append((us, rid))
                last = us
        if last is not None:
            self.last.update((int(last),))
        yield pd.DataFrame({"org_id": [key[0]] * len(fired), "service": [key[1]] * len(fired), "alert": [key[2]] * len(fired),
                            "us": [f[0] for f in fired], "id": [f[1] for f in fired]})

    def close(self) -> None:
        pass


def stream_cooldown(spark: SparkSession, src_dir: str, cooldown_seconds: float,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """T-4 on a stream: wanted alerts (org, service, event type) pass through a per-key cooldown state."""
    ev = events_stream(spark, src_dir, max_files_per_trigger=max_files_per_trigger)
    wanted = ev.select(views._org("user_id").alias("org_id"), views._svc("user_id").alias("service"), F.col("event_type").alias("alert"),
                       F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"))

    class Proc(CooldownProcessor):
        cooldown_us = int(round(cooldown_seconds * 1_000_000))

    fired = wanted.groupBy("org_id", "service", "alert").transformWithStateInPandas(
        statefulProcessor=Proc(), outputStructType="org_id string, service string, alert string, us long, id long",
        outputMode="Append", timeMode="None")
    out, ck = run_folder(spark, "cooldown-out"), run_folder(spark, "cooldown-ckpt")
    _with_rocksdb(spark, lambda: run_available(fired, out, ck))
    return read_batches(spark, out).drop("batch", "_batch")
