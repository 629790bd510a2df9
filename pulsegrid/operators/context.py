"""Case context: interval joins to logs and alerts, prompt text, summaries, notes.

Interval joins (logs of a case's service inside its padded time window,
recurrence candidates inside a lookback) are equi-joins on (org, service,
time bucket) followed by the exact range predicate: the window side is
copied into each bucket its interval touches, so a hot service is split by
time instead of landing in one task, and no cross product is formed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonfn
from ..functions.rules import CASE_CONTEXT_PADDING_SECONDS, RECURRENCE_LOOKBACK_SECONDS
from ..session import checkpoint_dir
from .substring import contains_join


def _bucket(ts: Column, bucket_us: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(bucket_us)).cast("bigint")


def interval_join(windows: DataFrame, points: DataFrame, keys, start: Column, end: Column, point_ts: str = "ts",
                  bucket_seconds: float = 3600.0) -> DataFrame:
    """Rows of ``points`` with ``start <= ts <= end`` of a window with equal ``keys`` (both ends inclusive)."""
    keys = list(keys)
    bus = int(bucket_seconds * 1_000_000)
    w = (windows.withColumn("_ws", start).withColumn("_we", end)
         .withColumn("_b", F.explode(F.sequence(_bucket(F.col("_ws"), bus), _bucket(F.col("_we"), bus)))))
    p = points.withColumn("_b", _bucket(F.col(point_ts), bus))
    j = w.join(p, [*keys, "_b"], "inner")
    return j.where((F.col(point_ts) >= F.col("_ws")) & (F.col(point_ts) <= F.col("_we"))).drop("_b", "_ws", "_we")


def case_context_logs(cases: DataFrame, logs: DataFrame,
                      padding_seconds: float = CASE_CONTEXT_PADDING_SECONDS,
                      bucket_seconds: float = 3600.0) -> DataFrame:
    """Logs of each case's org and service with ts in [opened_at - pad, updated_at + pad]."""
    pad = F.expr(f"INTERVAL {int(padding_seconds * 1_000_000)} MICROSECONDS")
    c = cases.select(F.col("id").alias("case_id"), "org_id", F.col("primary_service").alias("service"),
                     "opened_at", "updated_at")
    l = logs.select("org_id", "service", F.col("id").alias("log_id"), "ts", "level", "event", "message")
    return interval_join(c, l, ["org_id", "service"], F.col("opened_at") - pad, F.col("updated_at") + pad,
                         bucket_seconds=bucket_seconds)


def case_context_alerts(cases: DataFrame, alerts: DataFrame) -> DataFrame:
    c = cases.select(F.col("id").alias("case_id"))
    return alerts.join(c, "case_id", "left_semi")


def recurrence_candidates(groups: DataFrame, cases: DataFrame, keys=("org_id", "service"),
                          lookback_seconds: float = RECURRENCE_LOOKBACK_SECONDS) -> DataFrame:
    """Cases of the same keys updated within the lookback before each group starts (any status)."""
    keys = list(keys)
    look = F.expr(f"INTERVAL {int(lookback_seconds * 1_000_000)} MICROSECONDS")
    g = groups.select(*keys, "first_ts")
    c = cases.select(*[F.col(k) for k in keys], F.col("id").alias("cand_id"),
                     F.col("opened_at").alias("cand_opened_at"), F.col("updated_at").alias("cand_updated_at"))
    j = interval_join(g, c, keys, F.col("first_ts") - look, F.col("first_ts"), point_ts="cand_updated_at",
                      bucket_seconds=lookback_seconds)
    return j.where(F.col("cand_updated_at") < F.col("first_ts"))


def _lines(arr: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(arr, "\n"), F.lit("")), F.lit("none"))


def case_prompt(cases: DataFrame, alerts: DataFrame, logs: DataFrame, payloads: bool = False) -> DataFrame:
    """Prompt text per case: case line, signature, alert lines and log lines in time order ('none' if empty).

    ``alerts`` are the rolled-up alerts (one per case, service, metric) and
    ``logs`` the case-window logs, so each list is bounded by the case. With
    ``payloads`` an alert line ends with the alert's ``raw_payload``.
    """
    line = F.format_string("- [%s] %s on %s at %s seen %dx", "severity", "metric", "service",
                           F.date_format("triggered_at", "yyyy-MM-dd HH:mm:ss"), "duplicate_count")
    if payloads:
        line = F.concat(line, F.lit(" | "), F.coalesce("raw_payload", F.lit("None")))
    a = alerts.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "triggered_at", "id", line.alias("t")))), lambda x: x["t"]).alias("al"))
    lg = logs.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "ts", "log_id", F.format_string("[%s] [%s] [%s] %s", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "level",
                                        "event", "message").alias("t")))), lambda x: x["t"]).alias("ll"))
    c = cases.join(a, cases.id == a.case_id, "left").drop("case_id").join(lg, cases.id == lg.case_id, "left")
    text = F.concat(
        F.lit("CASE\nservice="), F.col("primary_service"), F.lit(" | status="), F.col("status"),
        F.lit(" | occurrence_count="), F.col("occurrence_count").cast("string"),
        F.lit("\nsignature: "), F.coalesce(F.col("signature_text"), F.lit("")),
        F.lit("\n\nALERTS\n"), _lines(F.col("al")), F.lit("\n\nLOGS\n"), _lines(F.col("ll")))
    return c.select(F.col("id").alias("case_id"), text.alias("prompt"),
                    F.coalesce(F.size("al"), F.lit(0)).alias("n_alerts"),
                    F.coalesce(F.size("ll"), F.lit(0)).alias("n_logs"))


SUMMARY_TASK = ("Summarize the case below for the engineer on call. Its breaches are grouped already and the decision whether it "
                "recurred is made: do not decide it again. Give a title, root causes ranked by likelihood, the evidence for "
                "them, and what to do next.")
# The fields of an answer and what each holds.
ANSWER_SCHEMA = """{"title": "at most 8 words",
 "hypotheses": [{"rank": 1, "text": "root cause", "confidence": 0-100}],
 "evidence": [{"type": "log|metric|pattern", "label": "source", "text": "detail"}],
 "ai_summary": "2 sentences: what happened, next step"}"""


def summary_prompt(cases: DataFrame, alerts: DataFrame, logs: DataFrame, task: str = SUMMARY_TASK,
                   answer: str = ANSWER_SCHEMA) -> DataFrame:
    """What a model is sent: the task, the case with its alerts' payloads, and the JSON to answer with."""
    body = case_prompt(cases, alerts, logs, payloads=True)
    return body.withColumn("prompt", F.concat(F.lit(f"{task}\n\n"), "prompt",
                                              F.lit(f"\n\nANSWER with this JSON alone, without markdown\n{answer}")))


def offline_summarizer(batches):
    """Deterministic stand-in for a hosted model: a JSON summary derived from the prompt."""
    import json
    for pdf in batches:
        out = []
        for p in pdf["prompt"]:
            first = next((x for x in p.split("\n") if x.startswith("service=")), p)
            service = first.split("|")[0].replace("service=", "").strip()
            n_err = p.count("[ERROR]") + p.count("[CRITICAL]")
            out.append("```json\n" + json.dumps({
                "title": f"{service} degradation",
                "hypotheses": [{"rank": 1, "text": f"{service} errors ({n_err} error logs)", "confidence": 60}],
                "evidence": [{"type": "log", "label": service, "text": f"{n_err} error logs"}],
                "ai_summary": f"{service} breached thresholds; investigate recent changes."}) + "\n```")
        yield pd.DataFrame({"case_id": pdf["case_id"], "response": out})


def summarize_cases(prompts: DataFrame, client: Callable | None = None) -> DataFrame:
    """Prompts to parsed summaries through a model client run with ``mapInPandas``.

    ``client`` maps an iterator of pandas frames (case_id, prompt) to frames
    (case_id, response); failures should yield a NULL response, which leaves
    the case queued (``s`` is NULL).
    """
    fn = client or offline_summarizer
    resp = prompts.select("case_id", "prompt").mapInPandas(fn, "case_id long, response string")
    return resp.withColumn("s", jsonfn.parse_summary("response"))


# What a prompt ends with when its first answer was no JSON, and the fields of an answer.
STRICT_SUFFIX = "\n\nIMPORTANT: Keep ai_summary under 60 words. Response must be valid complete JSON."
ANSWER_FIELDS = ("title", "hypotheses", "evidence", "ai_summary")
ANSWERS = "case_id long, response string"


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = f"{checkpoint_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(ANSWERS).parquet(path)


def model_answers(prompts: DataFrame, client: Callable | None = None,
                  store: Callable[[DataFrame, str], DataFrame] = _stored) -> DataFrame:
    """Two rounds of a model over prompts: case_id, outcome, reason, rounds, response and ``s`` of each.

    The answers of a round are written by ``store`` (rows, name) before anything reads them, so a prompt
    is sent once a round however many sinks follow, and all of them see the same answer. An answer that
    is no JSON is asked for once more with a stricter prompt. Outcomes: ``ok``, ``retried`` (the second
    answer will do), ``rejected`` with the reason ``no answer`` (the client failed, null), ``malformed``
    (twice no JSON) or ``missing field`` (not asked again); ``s`` is null then and the case stays queued.
    ``client`` is as in ``summarize_cases``; case ids are distinct.
    """
    fn = client or offline_summarizer

    def ask(rows: DataFrame, name: str) -> DataFrame:
        return store(rows.select("case_id", "prompt").mapInPandas(fn, ANSWERS), name)

    first = ask(prompts, "answers_first")
    failed = first.where(F.col("response").isNotNull() & ~jsonfn.is_json("response"))
    strict = (prompts.join(failed.select("case_id"), "case_id", "left_semi")
              .withColumn("prompt", F.concat("prompt", F.lit(STRICT_SUFFIX))))
    second = ask(strict, "answers_strict").select("case_id", F.col("response").alias("_second"), F.lit(2).alias("_rounds"))
    out = (first.join(second, "case_id", "left")
           .withColumn("rounds", F.coalesce("_rounds", F.lit(1)))
           .withColumn("response", F.when(F.col("rounds") == 2, F.col("_second")).otherwise(F.col("response"))))
    valid = jsonfn.is_json("response")
    whole = valid & jsonfn.has_fields("response", ANSWER_FIELDS)
    return out.select(
        "case_id",
        F.when(whole, F.when(F.col("rounds") == 2, "retried").otherwise("ok")).otherwise("rejected").alias("outcome"),
        F.when(F.col("response").isNull(), "no answer").when(~valid, "malformed").when(~whole, "missing field").alias("reason"),
        "rounds", "response", F.when(whole, jsonfn.parse_summary("response")).alias("s"))


def remediation_note(case_id: Column, service: Column, title: Column, ai_summary: Column, action_name: Column,
                     action_description: Column, hypotheses: Column) -> Column:
    """Markdown note for an applied action (title and summary fall back when empty)."""
    hyp = F.array_join(F.transform(F.coalesce(hypotheses, F.array().cast(
        "array<struct<rank:int,text:string,confidence:int>>")),
        lambda h: F.concat(F.lit("- ("), F.coalesce(h["confidence"].cast("string"), F.lit("None")), F.lit("%) "),
                           F.coalesce(h["text"], F.lit("None")))), "\n")
    return F.concat(
        F.lit("# Remediation for "), F.coalesce(service, F.lit("None")), F.lit(" — Case #"), case_id.cast("string"),
        F.lit("\n\n**Title:** "), F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled case")),
        F.lit("\n\n**AI summary:** "), F.coalesce(F.nullif(ai_summary, F.lit("")), F.lit("n/a")),
        F.lit("\n\n**Suggested action:** "), action_name, F.lit(" — "), action_description,
        F.lit("\n\n**Hypotheses:**\n"), hyp)


# Context fetch windows and the level filter of the service branch.
TRACE_LOOKBACK_SECONDS = 90.0
SERVICE_LOOKBACK_SECONDS = 300.0
SERVICE_LEVELS = "ERROR|CRITICAL|WARN"
TRACE_FIELD = "trace_id="


def fetch_context_logs(requests: DataFrame, lines: DataFrame, limit: int = 50,
                       trace_lookback: float = TRACE_LOOKBACK_SECONDS,
                       service_lookback: float = SERVICE_LOOKBACK_SECONDS) -> DataFrame:
    """Log lines for each request (req_id, org_id, as_of, service, trace_id), keeping the last ``limit`` lines.

    With a trace id: lines that hold ``trace_id=<id>`` anywhere, in [as_of - 90 s, as_of]; if there are
    none, or no trace id was given, lines matching ERROR|CRITICAL|WARN that hold the service anywhere,
    over 90 s after a trace id and 300 s otherwise; without a service, all such lines. Only lines of the
    request's org count. Both texts are found by ``substring.contains_join``; the hits by trace are
    written once, since the other branches ask for requests without any.
    """
    lk = lines.select("org_id", "line_id", "ts", "line")
    wanted = requests.select("req_id", "org_id", "as_of", F.nullif("trace_id", F.lit("")).alias("trace"),
                             F.nullif("service", F.lit("")).alias("needle"))

    def since(seconds: Column) -> Column:
        return F.col("as_of") - F.make_dt_interval(secs=seconds)

    def held(req: DataFrame, points: DataFrame, seconds: Column, bucket_seconds: float, branch: str) -> DataFrame:
        out = contains_join(req, points, ["org_id"], since(seconds), F.col("as_of"), bucket_seconds=bucket_seconds)
        return out.select("req_id", "line_id", "ts").withColumn("branch", F.lit(branch))

    traced = (wanted.where(F.col("trace").isNotNull())
              .select("req_id", "org_id", "as_of", F.concat(F.lit(TRACE_FIELD), "trace").alias("needle")))
    by_trace = held(traced, lk, F.lit(trace_lookback), trace_lookback, "trace").checkpoint()
    rest = (wanted.join(by_trace.select("req_id").distinct(), "req_id", "left_anti")
            .withColumn("_lb", F.when(F.col("trace").isNotNull(), F.lit(trace_lookback))
                        .otherwise(F.lit(service_lookback))).drop("trace"))
    levels = lk.where(F.col("line").rlike(SERVICE_LEVELS))
    by_service = held(rest, levels, F.col("_lb"), service_lookback, "service")
    by_level = (interval_join(rest.where(F.col("needle").isNull()).drop("needle"), levels, ["org_id"], since(F.col("_lb")),
                              F.col("as_of"), bucket_seconds=service_lookback)
                .select("req_id", "line_id", "ts").withColumn("branch", F.lit("level")))
    every = by_trace.unionByName(by_service).unionByName(by_level)
    w = Window.partitionBy("req_id").orderBy(F.col("ts").desc(), F.col("line_id").desc())
    return every.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")
