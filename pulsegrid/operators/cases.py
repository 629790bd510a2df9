"""Case and alert state as set-based folds over change rows.

Only plain parquet is assumed (no MERGE), so case and alert state are
computed as folds: the current state joined with a batch of changes
aggregated per key, producing the next state. Every fold is a keyed
aggregate (partially combined before the shuffle) plus one join on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import GROUPING_WINDOW_SECONDS


def alert_dedup_keys(breaches: DataFrame, window_seconds: float = GROUPING_WINDOW_SECONDS) -> DataFrame:
    """``service|metric|floor(epoch_seconds / window)`` per breach (time-bucket key)."""
    win_us = int(round(window_seconds * 1_000_000))
    bucket = F.floor(F.unix_micros("ts") / F.lit(win_us)).cast("bigint")
    return breaches.withColumn("dedup_key", F.concat_ws("|", "service", "metric", bucket.cast("string")))


def open_cases(groups: DataFrame, as_of=None) -> DataFrame:
    """New cases from breach groups (one tick is blind to itself: every group opens a case).

    ``groups`` come from ``signature.group_signatures``; ``as_of`` is the tick
    time (default: the group's last breach, which keeps replays deterministic).
    The id is a stable hash of (org, service, opened_at).
    """
    upd = F.col("last_ts") if as_of is None else F.lit(as_of).cast("timestamp")
    return groups.select(
        F.xxhash64("org_id", "service", "first_ts").alias("id"), "org_id",
        F.lit("OPEN").alias("status"), F.col("service").alias("primary_service"),
        F.col("first_ts").alias("opened_at"), upd.alias("updated_at"), "signature_text",
        F.lit(None).cast("decimal(5,4)").alias("similarity_score"), F.lit(1).alias("occurrence_count"),
        "severity", F.lit(None).cast("timestamp").alias("summarized_at"),
        F.lit(None).cast("timestamp").alias("matched_at"),
        F.array(F.struct(F.date_format(upd, "HH:mm:ss").alias("time"), F.lit("Case opened").alias("event"),
                         F.lit("#818cf8").alias("color"))).alias("timeline"),
    )


def recur_cases(cases: DataFrame, matches: DataFrame) -> DataFrame:
    """Fold a batch of duplicate matches (case_id, score, at, severity, seq) into case state.

    Per case: occurrence += matches, score and updated_at from the last match,
    severity only escalates, a RESOLVED case becomes INVESTIGATING and its
    summary and match markers are cleared so later stages run again.
    """
    m = matches.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by("score", F.struct("at", "seq", "score")).alias("_score"),
        F.max("at").alias("_at"),
        F.bool_or(F.col("severity") == "critical").alias("_crit"))
    j = cases.join(m, cases.id == m.case_id, "left")
    hit = F.col("_n").isNotNull()
    reopen = hit & (F.col("status") == "RESOLVED")
    return j.select(
        *[c for c in cases.columns if c not in ("occurrence_count", "similarity_score", "updated_at", "severity",
                                                 "summarized_at", "matched_at", "status")],
        F.when(reopen, F.lit("INVESTIGATING")).otherwise(F.col("status")).alias("status"),
        (F.col("occurrence_count") + F.coalesce("_n", F.lit(0))).cast("int").alias("occurrence_count"),
        F.when(hit, F.col("_score").cast("decimal(5,4)")).otherwise(F.col("similarity_score"))
        .alias("similarity_score"),
        F.when(hit, F.col("_at")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(F.coalesce("_crit", F.lit(False)), F.lit("critical")).otherwise(F.col("severity")).alias("severity"),
        F.when(reopen, F.lit(None)).otherwise(F.col("summarized_at")).alias("summarized_at"),
        F.when(reopen, F.lit(None)).otherwise(F.col("matched_at")).alias("matched_at"),
    )


ALERT_KEY = ("case_id", "service", "metric")


def alert_rollup(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Alert upsert per (case_id, service, metric).

    The first alert of a key keeps its id, severity, triggered_at, source tool,
    org and payload; every later one adds 1 to duplicate_count and replaces
    received_at. Batch order is (triggered_at, id), then the ingest sequence
    ``ingest_seq`` where the batch has one, then received_at and whatever else
    is kept: rows that agree in all of it are interchangeable, so the result
    does not depend on how twins were dealt. ``state`` may be empty;
    ``org_id`` and ``raw_payload`` are carried where both sides have them.
    """
    first = ["id", "severity", "triggered_at", "source_tool",
             *[c for c in ("org_id", "raw_payload") if c in batch.columns and c in state.columns]]
    sequence = ["ingest_seq"] if "ingest_seq" in batch.columns else []
    order = F.struct("triggered_at", "id", *sequence, "received_at", *first[1:2], *first[3:])
    agg = batch.groupBy(*ALERT_KEY).agg(
        F.min_by(F.struct(*first), order).alias("_first"), F.count(F.lit(1)).alias("_n"),
        F.max_by("received_at", order).alias("_recv"))
    s = state.select(*ALERT_KEY, F.struct(*first).alias("_known"), F.col("duplicate_count").alias("_sdup"),
                     F.col("received_at").alias("_srecv"))
    kept = F.coalesce("_known", "_first")
    return s.join(agg, list(ALERT_KEY), "full").select(
        kept["id"].alias("id"), *ALERT_KEY, *[kept[c].alias(c) for c in first[1:]],
        (F.coalesce("_sdup", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int").alias("duplicate_count"),
        F.coalesce("_recv", "_srecv").alias("received_at"))


def fold_timeline(entries: DataFrame, key: str = "case_id") -> DataFrame:
    """Timeline per case from entry rows (key, at, seq, time, event, color) in (at, seq) order."""
    return entries.groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "seq", F.struct("time", "event", "color").alias("e")))),
        lambda x: x["e"]).alias("timeline"))


def save_summaries(cases: DataFrame, results: DataFrame, as_of_col: str = "at") -> DataFrame:
    """Apply parsed summaries (case_id, s struct or NULL, at) to the queue (summarized_at IS NULL).

    Failed results (NULL struct) leave the case queued; the latest result per case wins.
    """
    ok = results.where(F.col("s").isNotNull()).groupBy("case_id").agg(
        F.max_by("s", F.col(as_of_col)).alias("_s"), F.max(as_of_col).alias("_at"))
    j = cases.join(ok, cases.id == ok.case_id, "left")
    take = F.col("summarized_at").isNull() & F.col("_s").isNotNull()
    keep = [c for c in cases.columns if c not in ("title", "ai_summary", "hypotheses", "evidence", "summarized_at")]
    hyp_t = "array<struct<rank:int,text:string,confidence:int>>"
    ev_t = "array<struct<type:string,label:string,text:string>>"
    return j.select(
        *keep,
        F.when(take, F.col("_s.title")).otherwise(F.col("title")).alias("title"),
        F.when(take, F.col("_s.ai_summary")).otherwise(F.col("ai_summary")).alias("ai_summary"),
        F.when(take, F.col("_s.hypotheses")).otherwise(
            F.col("hypotheses") if "hypotheses" in cases.columns else F.lit(None).cast(hyp_t)).alias("hypotheses"),
        F.when(take, F.col("_s.evidence")).otherwise(
            F.col("evidence") if "evidence" in cases.columns else F.lit(None).cast(ev_t)).alias("evidence"),
        F.when(take, F.col("_at")).otherwise(F.col("summarized_at")).alias("summarized_at"),
    )


def resolve_cases(cases: DataFrame, commands: DataFrame) -> DataFrame:
    """Resolve commands (case_id, org_id, at) applied within their org; others are ignored."""
    cmd = commands.groupBy("case_id", "org_id").agg(F.max("at").alias("_at"), F.count(F.lit(1)).alias("_n"))
    j = cases.join(cmd, (cases.id == cmd.case_id) & (cases.org_id == cmd.org_id), "left").drop(cmd.org_id)
    hit = F.col("_n").isNotNull()
    keep = [c for c in cases.columns if c not in ("status", "updated_at")]
    return j.select(*keep,
                    F.when(hit, F.lit("RESOLVED")).otherwise(F.col("status")).alias("status"),
                    F.when(hit, F.col("_at")).otherwise(F.col("updated_at")).alias("updated_at"),
                    F.coalesce("_n", F.lit(0)).alias("resolve_commands"))


def resolution_entries(cases: DataFrame, commands: DataFrame) -> DataFrame:
    """Timeline entries of resolve commands: one per command that names a case of its own org, also if resolved before."""
    known = cases.select(F.col("id").alias("case_id"), "org_id")
    return commands.join(known, ["case_id", "org_id"]).select(
        "case_id", "org_id", "at", F.date_format("at", "HH:mm:ss").alias("time"),
        F.lit("Case resolved").alias("event"), F.lit("#34d399").alias("color"))  # fixed values


def apply_actions(commands: DataFrame, cases: DataFrame, case_actions: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply-action commands (case_id, org_id, action_id, at) with their outcome.

    ``not_found``: no such case in that org; ``not_suggested``: the action was
    not suggested for the case; else ``applied``: ``raise_pr`` leaves the case
    open (only updated_at moves), every other action type resolves it.
    """
    c = cases.select(F.col("id").alias("case_id"), F.col("org_id").alias("_corg"), F.col("status").alias("_status"))
    sugg = case_actions.select("case_id", "action_id").distinct().withColumn("_sugg", F.lit(True))
    a = actions.select(F.col("id").alias("action_id"), "action_type", "name")
    j = (commands.join(c, (commands.case_id == c.case_id) & (commands.org_id == c._corg), "left")
         .drop(c.case_id)
         .join(sugg, ["case_id", "action_id"], "left")
         .join(a, "action_id", "left"))
    outcome = (F.when(F.col("_corg").isNull(), F.lit("not_found"))
               .when(F.col("_sugg").isNull(), F.lit("not_suggested"))
               .otherwise(F.lit("applied")))
    new_status = (F.when(outcome != "applied", F.col("_status"))
                  .when(F.col("action_type") == "raise_pr", F.col("_status"))
                  .otherwise(F.lit("RESOLVED")))
    return j.select("case_id", "org_id", "action_id", "at", outcome.alias("outcome"), "action_type", "name",
                    new_status.alias("new_status"), *[c for c in ("user_id", "pr_url") if c in commands.columns])


def applied_results(applied: DataFrame) -> DataFrame:
    """Applied commands (from ``apply_actions``, with user_id and pr_url) with ``result`` JSON and timeline ``entries``."""
    pr = F.col("action_type") == "raise_pr"
    note = F.concat(F.lit("Simulated '"), F.col("action_type"), F.lit("': "), F.col("name"))
    result = F.when(pr, F.to_json(F.struct("pr_url"))).otherwise(
        F.to_json(F.struct(F.lit(True).alias("simulated"), note.alias("note"))))
    event = F.when(pr, F.concat(F.lit("PR opened: "), F.coalesce("pr_url", F.lit("None")), F.lit(" — awaiting merge"))) \
        .otherwise(F.concat(F.lit("Applied: "), F.col("name")))
    first = F.struct(event.alias("event"), F.lit("#60a5fa").alias("color"))
    done = F.struct(F.lit("Case resolved").alias("event"), F.lit("#34d399").alias("color"))
    return (applied.where(F.col("outcome") == "applied").withColumn("result", result)
            .withColumn("entries", F.when(pr, F.array(first)).otherwise(F.array(first, done))))


def apply_to_case_actions(case_actions: DataFrame, results: DataFrame) -> DataFrame:
    """case_actions with status, applied_by, applied_at and result after the commands (the last one wins)."""
    last = results.groupBy("case_id", "action_id").agg(
        F.max_by(F.struct("user_id", "at", "result"), F.col("at")).alias("_r"))
    hit = F.col("_r").isNotNull()
    return case_actions.join(last, ["case_id", "action_id"], "left").select(
        *case_actions.columns, F.when(hit, "applied").otherwise("suggested").alias("status"),
        F.col("_r.user_id").alias("applied_by"), F.col("_r.at").alias("applied_at"), F.col("_r.result").alias("result"))


def apply_to_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """cases with the status and updated_at that the applied commands leave."""
    last = results.groupBy("case_id").agg(
        F.max("at").alias("_at"), F.bool_or(F.col("new_status") == "RESOLVED").alias("_done"))
    return cases.join(last, cases.id == last.case_id, "left").withColumns({
        "status": F.when(F.col("_done"), F.lit("RESOLVED")).otherwise(F.col("status")),
        "updated_at": F.coalesce("_at", "updated_at")}).drop("case_id", "_at", "_done")


def work_queues(cases: DataFrame) -> DataFrame:
    """Stage of each case: ``summarize`` (summarized_at NULL), ``match`` (summarized, not matched), else ``done``."""
    stage = (F.when(F.col("summarized_at").isNull(), F.lit("summarize"))
             .when(F.col("matched_at").isNull(), F.lit("match")).otherwise(F.lit("done")))
    return cases.withColumn("queue", stage)
