"""Poll ticks as micro-batches: detect, group, decide recurrence, keep case state; then the later stages.

One micro-batch is one tick. Groups of a tick do not see each other; a case
opened by one tick is a candidate for the next. Work is parallel over keys
inside a tick and sequential over ticks, which is what the order dependence
allows.

State is a folder of append-only logs, ``<state>/<log>/batch=<id>``, and the
streams' checkpoints in the same folder, so a restarted job goes on with the
next batch id over the same logs. A batch is written with overwrite and reads
only batches before its own: a retried batch finds what the first attempt
found and replaces its own rows. Only a log that does not exist counts as
empty; every other read failure ends the batch.

Order of a case's versions: ``cases`` rows are written by ticks alone, the
last batch wins. ``epoch`` counts how often a case was reopened. Resolutions,
summaries and matches are rows of their own that name the epoch they belong
to, and count only while the case is in it. So no stage overwrites another,
and an older summary cannot undo a newer reopening.

A log that is read as a state (``STATE_LOGS``) is kept like a log-structured merge tree: every
``COMPACT_EVERY`` batches a tick folds the last snapshot and the batches behind it, one row per key,
into a new snapshot ``<state>/_snapshots/<log>/upto=<batch>``. Readers open the newest snapshot they
may see and the batch folders behind it, never the older ones, so a tick reads as much after a year
as after a day if as many cases are known. Only batches that can no longer be replaced are folded;
a write to a folded batch is refused. A snapshot counts once it is complete; the two newest stay, for
readers that have opened the older one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.catalog_data import actions_frame
from ..functions.rules import (RECURRENCE_LOOKBACK_SECONDS, RSS_TREND_MIN_MB, RSS_TREND_SLOPE_MB_PER_MIN,
                               SIMILARITY_THRESHOLD)
from ..operators import cases as cases_op
from ..operators import context, detect, embed, incidents, sessionize, signature, similarity
from ..sources import views
from . import jobs

HYPOTHESES = "array<struct<rank:int,text:string,confidence:int>>"
EVIDENCE = "array<struct<type:string,label:string,text:string>>"
CASE_COLUMNS = ("id", "org_id", "status", "primary_service", "opened_at", "updated_at", "signature_text",
                "similarity_score", "occurrence_count", "severity", "vector", "epoch")
LOGS = {
    "cases": "id bigint, org_id string, status string, primary_service string, opened_at timestamp, "
             "updated_at timestamp, signature_text string, similarity_score decimal(5,4), occurrence_count int, "
             "severity string, vector array<float>, epoch int",
    "groups": "gid bigint, org_id string, service string, group_start timestamp, first_ts timestamp, "
              "last_ts timestamp, severity string, signature_text string, vector array<float>",
    "alerts": "org_id string, case_id bigint, service string, metric string, severity string, "
              "triggered_at timestamp, raw_payload string, source_tool string, n bigint, received_at timestamp",
    "timeline": "case_id bigint, org_id string, at timestamp, seq bigint, event string, color string",
    "recent_metrics": "id bigint, org_id string, service string, ts timestamp, rss_mb decimal(18,3)",
    "resolutions": "id bigint, epoch int, at timestamp",
    "summaries": f"id bigint, epoch int, title string, ai_summary string, hypotheses {HYPOTHESES}, "
                 f"evidence {EVIDENCE}, at timestamp",
    "pins": "name string, last bigint",
    "answers_first": context.ANSWERS,
    "answers_strict": context.ANSWERS,
    "rejects": "id bigint, epoch int, reason string, rounds int, response string, at timestamp",
    "matches": "id bigint, epoch int, n_actions bigint, at timestamp",
    "case_actions": "case_id bigint, epoch int, action_id bigint, score double, rank int",
}
RESOLVED_BATCHES = -(1 << 40)  # timeline batches of resolutions, apart from those of ticks and stages
# Source tool of tick alerts; the texts and colours of timeline entries below are fixed too.
SOURCE_TOOL = "stage1_poller"


@dataclass(frozen=True)
class Trend:
    """Trailing memory trend of a tick: lookback, least slope and least mean of the later half."""

    lookback_seconds: float = 120.0
    slope_mb_per_min: float = RSS_TREND_SLOPE_MB_PER_MIN
    min_mb: float = RSS_TREND_MIN_MB


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders ``<path>/<name>=<number>``, ascending; none if there is no such path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{name}="))


def _committed(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return any(not f.getPath().getName().startswith(("_", "."))
               for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))


def read_log(spark: SparkSession, state_dir: str, name: str, before: int | None = None, after: int | None = None,
             only: int | None = None) -> DataFrame:
    """Rows of a log with their ``batch``: of batches below ``before``, above ``after``, or of one alone.

    Folders of other batches are not opened.
    """
    path, schema = f"{state_dir}/{name}", f"{LOGS[name]}, batch bigint"
    wanted = [b for b in _numbered(spark, path, "batch") if (before is None or b < before)
              and (after is None or b > after) and (only is None or b == only)]
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/batch={b}" for b in wanted])


def _write(df: DataFrame, state_dir: str, name: str, batch_id: int) -> None:
    folded = _snapshots(df.sparkSession, state_dir, name) if name in STATE_LOGS else []
    if folded and batch_id <= folded[-1]:
        raise ValueError(f"batch {batch_id} of {name} is part of the snapshot of batch {folded[-1]}")
    names = [c.strip().split(" ")[0] for c in _fields(LOGS[name])]
    df.select(*names).write.mode("overwrite").parquet(f"{state_dir}/{name}/batch={batch_id}")


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def _last(df: DataFrame, keys, order: str) -> DataFrame:
    """The row of each key with the highest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def _fold_alerts(rows: DataFrame) -> DataFrame:
    """One row per (case, service, metric): the first one's values, all occurrences, the last arrival."""
    first = F.min_by(F.struct("org_id", "severity", "triggered_at", "raw_payload", "source_tool"), F.col("batch"))
    return (rows.groupBy("case_id", "service", "metric")
            .agg(first.alias("f"), F.sum("n").alias("n"), F.max("received_at").alias("received_at"),
                 F.min("batch").alias("batch"))
            .select("case_id", "service", "metric", "f.*", "n", "received_at", "batch"))


PATCHES = ("resolutions", "summaries", "matches")
# How rows of a log become one row per key; folding a folded part with later rows gives the whole fold.
STATE_LOGS = {"cases": lambda rows: _last(rows, ["id"], "batch"), "alerts": _fold_alerts,
              **{name: lambda rows: _last(rows, ["id", "epoch"], "batch") for name in PATCHES}}
COMPACT_EVERY = 8  # batches behind the last snapshot that make the next one worth writing
_KEPT_SNAPSHOTS = 2


def _snapshots(spark: SparkSession, state_dir: str, name: str) -> list[int]:
    """Last batches of the complete snapshots of a log, ascending."""
    path = f"{state_dir}/_snapshots/{name}"
    return [u for u in _numbered(spark, path, "upto") if _exists(spark, f"{path}/upto={u}/_SUCCESS")]


def read_state(spark: SparkSession, state_dir: str, name: str, before: int | None = None) -> DataFrame:
    """The fold of a log's batches below ``before`` (all by default): the newest snapshot that may be seen, and what follows."""
    usable = [u for u in _snapshots(spark, state_dir, name) if before is None or u < before]
    schema = f"{LOGS[name]}, batch bigint"
    if not usable:
        return STATE_LOGS[name](read_log(spark, state_dir, name, before))
    base = spark.read.schema(schema).parquet(f"{state_dir}/_snapshots/{name}/upto={usable[-1]}")
    return STATE_LOGS[name](base.unionByName(read_log(spark, state_dir, name, before, after=usable[-1])))


def compact(spark: SparkSession, state_dir: str, name: str, before: int) -> None:
    """A snapshot of the batches below ``before``, if ``COMPACT_EVERY`` of them are behind the last one."""
    old = _snapshots(spark, state_dir, name)
    fresh = [b for b in _numbered(spark, f"{state_dir}/{name}", "batch") if b < before and (not old or b > old[-1])]
    if len(fresh) < COMPACT_EVERY:
        return
    path = f"{state_dir}/_snapshots/{name}"
    names = [c.strip().split(" ")[0] for c in _fields(f"{LOGS[name]}, batch bigint")]
    read_state(spark, state_dir, name, before).select(*names).write.mode("overwrite").parquet(f"{path}/upto={fresh[-1]}")
    for u in old[:1 - _KEPT_SNAPSHOTS]:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/upto={u}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def patches_of(spark: SparkSession, state_dir: str, batch_id: int) -> dict[str, int | None]:
    """The last batch of each patch log that a tick reads: noted by its first attempt, found again by a retry."""
    if not _exists(spark, f"{state_dir}/pins/batch={batch_id}/_SUCCESS"):
        last = [(name, next((b for b in reversed(_numbered(spark, f"{state_dir}/{name}", "batch"))
                             if _committed(spark, f"{state_dir}/{name}/batch={b}")), None)) for name in PATCHES]
        _write(spark.createDataFrame(last, LOGS["pins"]).coalesce(1), state_dir, "pins", batch_id)
    return {r["name"]: r["last"] for r in read_log(spark, state_dir, "pins", only=batch_id).collect()}  # one row per log


def current_cases(spark: SparkSession, state_dir: str, before: int | None = None,
                  upto: dict[str, int | None] | None = None) -> DataFrame:
    """Latest version of each case with what holds in its epoch: resolution, summary, match.

    ``upto`` names the last batch of each patch log that counts (None: no batch); by default all do.
    """
    def patches(name: str) -> DataFrame:
        if upto is not None and upto[name] is None:
            return spark.createDataFrame([], LOGS[name])
        return read_state(spark, state_dir, name, None if upto is None else upto[name] + 1).drop("batch")

    cases = read_state(spark, state_dir, "cases", before).drop("batch")
    patch = {name: patches(name) for name in PATCHES}
    resolved = patch["resolutions"].withColumnRenamed("at", "resolved_at")
    summary = patch["summaries"].withColumnRenamed("at", "summarized_at")
    matched = patch["matches"].withColumnRenamed("at", "matched_at").drop("n_actions")
    out = cases.join(resolved, ["id", "epoch"], "left").join(summary, ["id", "epoch"], "left").join(
        matched, ["id", "epoch"], "left")
    done = F.col("resolved_at").isNotNull()
    return (out.withColumn("status", F.when(done, F.lit("RESOLVED")).otherwise(F.col("status")))
            .withColumn("updated_at", F.greatest("updated_at", "resolved_at")).drop("resolved_at"))


def current_alerts(spark: SparkSession, state_dir: str) -> DataFrame:
    """One alert per (case, service, metric): the first one's values, all occurrences counted."""
    return (read_state(spark, state_dir, "alerts").withColumn("id", F.xxhash64("case_id", "service", "metric"))
            .withColumn("duplicate_count", F.col("n").cast("int"))
            .select("id", "case_id", "service", "metric", "org_id", "severity", "triggered_at", "raw_payload", "source_tool",
                    "duplicate_count", "received_at"))


def current_timeline(spark: SparkSession, state_dir: str) -> DataFrame:
    """Entries of all cases with a total order per case (at, seq)."""
    return read_log(spark, state_dir, "timeline").select(
        "case_id", "org_id", "at", "seq", F.date_format("at", "HH:mm:ss").alias("time"), "event", "color")


def _recent_metrics(spark: SparkSession, metrics: DataFrame, state_dir: str, batch_id: int, since) -> DataFrame:
    """Memory values after ``since``: those of this batch, and those the batch before has kept."""
    own = metrics.select("id", "org_id", "service", "ts", F.col("rss_mb").cast("decimal(18,3)").alias("rss_mb"))
    earlier = [b for b in _numbered(spark, f"{state_dir}/recent_metrics", "batch") if b < batch_id]
    both = own.unionByName(read_log(spark, state_dir, "recent_metrics", only=earlier[-1]).drop("batch")) if earlier else own
    return both.where((F.col("ts") > since) & F.col("rss_mb").isNotNull())


def _back(at, seconds: float):
    return F.lit(at) - F.expr(f"INTERVAL {int(seconds * 1_000_000)} MICROSECONDS")


def tick(spark: SparkSession, events: DataFrame, state_dir: str, batch_id: int, gap_seconds: float,
         threshold: float = SIMILARITY_THRESHOLD, lookback_seconds: float = RECURRENCE_LOOKBACK_SECONDS,
         mode: str = "pre_filter", dim: int = embed.DEFAULT_DIM, embedder=None, trend: Trend = Trend()) -> None:
    """One poll tick over a batch of events: appends cases, alerts, timeline entries and kept metrics."""
    metrics, logs = views.metrics_from(events), views.logs_from(events)
    as_of = metrics.select("ts").unionByName(logs.select("ts")).agg(F.max("ts")).first()[0]  # tick time: a scalar
    if as_of is None:
        return
    recent = _recent_metrics(spark, metrics, state_dir, batch_id, _back(as_of, trend.lookback_seconds))
    _write(recent, state_dir, "recent_metrics", batch_id)
    recent = read_log(spark, state_dir, "recent_metrics", only=batch_id)
    parts = (detect.detect_metric_breaches(metrics),
             detect.detect_rss_trend(recent, slope_mb_per_min=trend.slope_mb_per_min, min_mb=trend.min_mb),
             detect.detect_error_logs(logs))
    breaches = parts[0].select(*detect.BREACH_COLUMNS)
    for p in parts[1:]:
        breaches = breaches.unionByName(p.select(*detect.BREACH_COLUMNS))
    grouped = sessionize.sessionize(breaches, ["org_id", "service"], gap_seconds, order_cols=["seq", "src_id", "sub"])
    signed = embed.embed_text(signature.session_signatures(breaches, gap_seconds), "signature_text", dim=dim, embedder=embedder)
    numbered = incidents.global_sequence(signed, ["first_ts", "org_id", "service"], F.to_date("first_ts"),
                                         start=(batch_id + 1) * 1_000_000_000 + 1, out_col="gid")
    _write(numbered.withColumn("vector", F.col("vector").cast("array<float>")), state_dir, "groups", batch_id)
    groups = read_log(spark, state_dir, "groups", only=batch_id).drop("batch")

    pinned = patches_of(spark, state_dir, batch_id)
    for name in ("cases", "alerts"):
        compact(spark, state_dir, name, batch_id)
    for name, last in pinned.items():
        if last is not None:
            compact(spark, state_dir, name, last)  # the last batch itself may still be replaced by a retry
    state = current_cases(spark, state_dir, before=batch_id, upto=pinned)
    q = groups.select(F.col("gid").alias("case_id"), "org_id", "service", "vector")
    idx = state.select(F.col("id").alias("case_id"), "org_id", F.col("primary_service").alias("service"), "vector",
                       "updated_at")
    if mode == "pre_filter":
        idx = idx.where(F.col("updated_at") >= _back(as_of, lookback_seconds)).drop("updated_at")
        dec = similarity.dedup_pre_filter(q, idx, threshold=threshold)
    else:
        dec = similarity.dedup_post_filter(
            q.withColumn("updated_at", F.lit(as_of)), idx, threshold=threshold,
            recent=lambda qc, ic: ic("updated_at") >= _back(as_of, lookback_seconds))
    g = groups.join(dec.withColumnRenamed("case_id", "gid"), "gid").withColumn(
        "case_id", F.when(F.col("is_duplicate"), F.col("matched_case_id")).otherwise(F.col("gid")))

    entry = F.when(F.col("is_duplicate"), F.struct(F.concat(F.lit("Recurred ("), "service", F.lit(")")).alias("event"),
                                                   F.lit("#fbbf24").alias("color"))) \
        .otherwise(F.struct(F.lit("Case opened").alias("event"), F.lit("#818cf8").alias("color")))
    _write(g.select("case_id", "org_id", F.lit(as_of).alias("at"), F.col("gid").alias("seq"), entry.alias("e"))
           .select("*", "e.*"), state_dir, "timeline", batch_id)
    _write(_batch_alerts(grouped, g, as_of), state_dir, "alerts", batch_id)

    opened = g.where(~F.col("is_duplicate")).select(
        F.col("gid").alias("id"), "org_id", F.lit("OPEN").alias("status"), F.col("service").alias("primary_service"),
        F.col("first_ts").alias("opened_at"), F.lit(as_of).alias("updated_at"), "signature_text",
        F.col("score").cast("decimal(5,4)").alias("similarity_score"), F.lit(1).alias("occurrence_count"), "severity",
        "vector", F.lit(0).alias("epoch"))
    matches = g.where(F.col("is_duplicate")).select(
        "case_id", "score", F.lit(as_of).cast("timestamp").alias("at"),
        F.struct("first_ts", "gid").alias("seq"), "severity")
    touched = (state.join(matches.select(F.col("case_id").alias("id")).distinct(), "id", "left_semi")
               .withColumn("epoch", F.col("epoch") + (F.col("status") == "RESOLVED").cast("int")))
    # written last: later stages wake up on this log
    _write(opened.unionByName(cases_op.recur_cases(touched, matches).select(*CASE_COLUMNS)), state_dir, "cases", batch_id)


def _batch_alerts(grouped: DataFrame, decided: DataFrame, as_of) -> DataFrame:
    """Alerts of a tick's breaches, rolled up per (case, service, metric): the first one and their number."""
    payload = F.to_json(F.struct("service", "metric", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
                                 "severity", "event", "message", "trace_id"), {"ignoreNullFields": "false"})
    member = decided.select("org_id", "service", "group_start", "case_id")
    first = F.min_by(F.struct("severity", F.col("ts").alias("triggered_at"), payload.alias("raw_payload")),
                     F.struct("ts", "seq", "src_id", "sub"))
    return (grouped.join(member, ["org_id", "service", "group_start"])
            .groupBy("org_id", "case_id", "service", "metric").agg(first.alias("f"), F.count(F.lit(1)).alias("n"))
            .select("org_id", "case_id", "service", "metric", "f.*", F.lit(SOURCE_TOOL).alias("source_tool"), "n",
                    F.lit(as_of).alias("received_at")))


def _run(spark: SparkSession, source: DataFrame, state_dir: str, stage: str, on_batch, processing_time=None) -> None:
    w = source.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{state_dir}/_checkpoints/{stage}")
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    w.start().awaitTermination()


def stream_recurrence(spark: SparkSession, src_dir: str, glob: str, gap_seconds: float, state_dir: str,
                      threshold: float = SIMILARITY_THRESHOLD,
                      lookback_seconds: float = RECURRENCE_LOOKBACK_SECONDS, mode: str = "pre_filter",
                      max_files_per_trigger: int = 1, processing_time: str | None = None, embedder=None,
                      trend: Trend = Trend()) -> DataFrame:
    """Stage 1 as a stream of ticks; returns the current case state when the input is drained."""
    ev = jobs.events_stream(spark, src_dir, glob=glob, max_files_per_trigger=max_files_per_trigger)

    def on_batch(df: DataFrame, batch_id: int):
        tick(spark, df, state_dir, batch_id, gap_seconds, threshold, lookback_seconds, mode, embedder=embedder,
             trend=trend)

    _run(spark, ev, state_dir, "ticks", on_batch, processing_time)
    return current_cases(spark, state_dir)


def resolve(spark: SparkSession, state_dir: str, ids: list[int], batch_id: int, at) -> None:
    """Records that cases were resolved in their present epoch."""
    known = current_cases(spark, state_dir).where(F.col("id").isin(ids))
    done = known.select("id", "org_id", "epoch", F.lit(at).cast("timestamp").alias("at"))
    _write(done, state_dir, "resolutions", batch_id)
    _stage_entry(done, F.lit("Case resolved"), "#34d399", state_dir, "timeline", RESOLVED_BATCHES - batch_id)


def _wake(spark: SparkSession, state_dir: str, name: str) -> DataFrame:
    """The stream of a log's rows, which wakes up the next stage."""
    return spark.readStream.schema(f"{LOGS[name]}, batch bigint").parquet(f"{state_dir}/{name}")


def summarize_stage(spark: SparkSession, state_dir: str, logs: DataFrame, client=None) -> None:
    """Stage 2: all cases without a summary in their epoch are summarised; rejected answers leave them queued.

    Answers are written before the summary, its timeline entry and the rejects are, which all read them.
    """
    def on_batch(_: DataFrame, batch_id: int):
        done = read_state(spark, state_dir, "summaries", batch_id).select("id", "epoch")
        queue = current_cases(spark, state_dir).join(done, ["id", "epoch"], "left_anti")
        prompts = context.summary_prompt(queue, current_alerts(spark, state_dir), context.case_context_logs(queue, logs))
        told = context.model_answers(prompts, client, _once(spark, state_dir, batch_id)).withColumnRenamed("case_id", "id")
        told = queue.select("id", "epoch", "org_id").join(told, "id").withColumn("at", F.current_timestamp())
        _write(told.where(F.col("outcome") == "rejected"), state_dir, "rejects", batch_id)
        saved = told.where(F.col("outcome") != "rejected")
        _stage_entry(saved, F.lit("AI summary generated"), "#a78bfa", state_dir, "timeline", -2 * batch_id - 1)
        _write(saved.select("id", "epoch", F.col("s.title").alias("title"), F.col("s.ai_summary").alias("ai_summary"),
                            F.col("s.hypotheses").alias("hypotheses"), F.col("s.evidence").alias("evidence"), "at"),
               state_dir, "summaries", batch_id)

    _run(spark, _wake(spark, state_dir, "cases"), state_dir, "summaries", on_batch)


def match_stage(spark: SparkSession, state_dir: str, actions: DataFrame | None = None, embedder=None) -> None:
    """Stage 3: summarised cases without a match in their epoch get their top actions; an empty catalog leaves them."""
    acts = actions if actions is not None else actions_frame(spark)

    def on_batch(_: DataFrame, batch_id: int):
        done = read_state(spark, state_dir, "matches", batch_id).select("id", "epoch")
        queue = current_cases(spark, state_dir).where(F.col("summarized_at").isNotNull()).join(
            done, ["id", "epoch"], "left_anti").select("id", "epoch", "org_id", "title", "ai_summary")
        found = embed.match_actions(queue, acts, embedder=embedder).join(
            queue.select(F.col("id").alias("case_id"), "epoch", "org_id"), "case_id")
        _write(found, state_dir, "case_actions", batch_id)
        rows = read_log(spark, state_dir, "case_actions", only=batch_id)
        counted = (rows.groupBy(F.col("case_id").alias("id"), "epoch").agg(F.count(F.lit(1)).alias("n_actions"))
                   .withColumn("at", F.current_timestamp()))
        _stage_entry(counted.join(queue.select("id", "org_id"), "id"),
                     F.concat(F.col("n_actions").cast("string"), F.lit(" remediation action(s) suggested")), "#34d399",
                     state_dir, "timeline", -2 * batch_id - 2)
        _write(counted, state_dir, "matches", batch_id)

    _run(spark, _wake(spark, state_dir, "summaries"), state_dir, "matches", on_batch)


def _once(spark: SparkSession, state_dir: str, batch_id: int):
    """Storage for ``context.model_answers``: a retried batch reads the answers that it has already paid for."""
    def store(rows: DataFrame, name: str) -> DataFrame:
        if not _exists(spark, f"{state_dir}/{name}/batch={batch_id}/_SUCCESS"):
            _write(rows, state_dir, name, batch_id)
        return read_log(spark, state_dir, name, only=batch_id).drop("batch")
    return store


def _stage_entry(rows: DataFrame, event, color: str, state_dir: str, name: str, batch: int) -> None:
    """Timeline entries of stages 2 and 3: batches below zero, odd and even, apart from the ticks' own."""
    _write(rows.select(F.col("id").alias("case_id"), "org_id", "at", F.lit(0).cast("bigint").alias("seq"),
                       event.alias("event"), F.lit(color).alias("color")), state_dir, name, batch)


def initial_checkpoint(saved, newest, now):
    """Where polling starts: the saved checkpoint, else the newest timestamp seen, else now."""
    return F.coalesce(F.lit(saved).cast("timestamp"), F.lit(newest).cast("timestamp"), F.lit(now).cast("timestamp"))


def split_by_day(spark: SparkSession, src_dir: str, out_dir: str, days: int = 7) -> str:
    """Replay input for tests: the events table as one file per ``days``-day slice, written in time order."""
    ev = spark.read.parquet(f"{src_dir.rstrip('/')}/events.parquet")
    slice_col = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (days * 86400)).cast("bigint")
    slices = [r[0] for r in ev.select(slice_col.alias("s")).distinct().orderBy("s").collect()]
    for s in slices:  # one small write per slice keeps file order = time order
        ev.where(slice_col == s).coalesce(1).write.mode("append").parquet(out_dir)
    return out_dir
