"""Registered report plans: each takes (spark, sf_dir) and returns a DataFrame.

These wire the library operators to the driver views with the parameters the
driver data needs (``gap=1800 s`` and ``similarity=0.30``; see FIXTURES.md)
and flatten results for comparison: timestamps as ISO text with microseconds,
decimals as doubles, doubles rounded to 6 places, lists joined to text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, sessionize, signature
from ..session import checkpoint_dir
from ..sources import views

# Parameters the driver data needs (event spacing is minutes).
DRIVER_GAP_SECONDS = 1800.0
# Trailing window, slide and trend thresholds (hourly spacing per key, so slopes per minute are small).
DRIVER_TREND_WINDOW = "6 hours"
DRIVER_TREND_SLIDE = "1 hour"
DRIVER_TREND_SLOPE, DRIVER_TREND_MIN_MB = 0.1, 150.0
DRIVER_SIMILARITY = 0.30

REPORTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def report(name: str):
    def deco(fn):
        REPORTS[name] = fn
        return fn
    return deco


def iso(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


# ---------------------------------------------------------------- detection

def _breaches(spark, sf_dir) -> DataFrame:
    return detect.all_breaches(views.metrics_v(spark, sf_dir), views.logs_v(spark, sf_dir),
                               trend_window=DRIVER_TREND_WINDOW, trend_slide=DRIVER_TREND_SLIDE,
                               slope_mb_per_min=DRIVER_TREND_SLOPE, min_mb=DRIVER_TREND_MIN_MB)


def _grouped(spark, sf_dir) -> DataFrame:
    return sessionize.sessionize(_breaches(spark, sf_dir), ["org_id", "service"], DRIVER_GAP_SECONDS,
                                 order_cols=["seq", "src_id", "sub"])


def _breach_out(df: DataFrame) -> DataFrame:
    return df.select("org_id", "service", "metric", r6("value").alias("value"), iso("ts").alias("ts"),
                     "severity", "event", "message", "trace_id", "seq", "src_id")


@report("breach_group_rollup")
def breach_group_rollup(spark, sf_dir):
    sig = signature.session_signatures(_breaches(spark, sf_dir), DRIVER_GAP_SECONDS)
    return sig.select(
        "org_id", "service", iso("first_ts").alias("first_ts"), iso("last_ts").alias("last_ts"),
        "n_breaches", "severity", F.array_join("metrics", ",").alias("metrics"),
        F.array_join("events", ",").alias("events"), "signature_text")


def _one_rule(spark, sf_dir, metric):
    from ..functions.rules import DEFAULT_RULES
    rules = tuple(r for r in DEFAULT_RULES if r.metric == metric)
    return _breach_out(detect.detect_metric_breaches(views.metrics_v(spark, sf_dir), rules))


@report("detect_error_rate")
def detect_error_rate(spark, sf_dir):
    return _one_rule(spark, sf_dir, "error_rate")


@report("detect_p99")
def detect_p99(spark, sf_dir):
    return _one_rule(spark, sf_dir, "p99_latency_ms")


@report("detect_connections")
def detect_connections(spark, sf_dir):
    return _one_rule(spark, sf_dir, "active_connections")


@report("detect_metric_breaches")
def detect_metric_breaches(spark, sf_dir):
    return _breach_out(detect.detect_metric_breaches(views.metrics_v(spark, sf_dir)))


# Rules that a user of the driver data has added as rows to the default ones.
DRIVER_ADDED_RULES = (("p99_latency_ms", 1200.0, 1), ("rss_mb", 180.0, 1))


@report("detect_rule_rows")
def detect_rule_rows(spark, sf_dir):
    from ..functions.rules import DEFAULT_RULES, Rule, rules_frame
    rules = rules_frame(spark, (*DEFAULT_RULES, *[Rule(*r) for r in DRIVER_ADDED_RULES]))
    out = detect.detect_by_rules(views.metrics_v(spark, sf_dir), rules)
    return out.select(F.col("sub").alias("rule_id"), "org_id", "service", "metric", r6("value").alias("value"),
                      iso("ts").alias("ts"), "severity", "src_id")


@report("detect_rss_trend")
def detect_rss_trend(spark, sf_dir):
    return _breach_out(detect.detect_rss_trend(views.metrics_v(spark, sf_dir), slope_mb_per_min=0.00005,
                                               min_mb=160.0, bucket_seconds=86400.0))


@report("detect_rss_trend_sliding")
def detect_rss_trend_sliding(spark, sf_dir):
    out = detect.detect_rss_trend_sliding(views.metrics_v(spark, sf_dir), DRIVER_TREND_WINDOW, DRIVER_TREND_SLIDE,
                                          slope_mb_per_min=DRIVER_TREND_SLOPE, min_mb=DRIVER_TREND_MIN_MB)
    return out.select("org_id", "service", iso("win_start").alias("win_start"), r6("value").alias("value"),
                      iso("ts").alias("ts"), "severity")


@report("detect_error_logs")
def detect_error_logs(spark, sf_dir):
    return _breach_out(detect.detect_error_logs(views.logs_v(spark, sf_dir)))


@report("all_breaches")
def all_breaches(spark, sf_dir):
    return _breach_out(_breaches(spark, sf_dir))


@report("breach_groups")
def breach_groups(spark, sf_dir):
    return _grouped(spark, sf_dir).select(
        "org_id", "service", "metric", iso("ts").alias("ts"), "seq", "src_id", "sub",
        iso("group_start").alias("group_start"))


@report("signature_text")
def signature_text_report(spark, sf_dir):
    sig = signature.session_signatures(_breaches(spark, sf_dir), DRIVER_GAP_SECONDS)
    return sig.select("org_id", "service", iso("first_ts").alias("first_ts"), "signature_text")


@report("service_catalog")
def service_catalog(spark, sf_dir):
    from ..operators import catalog
    from ..sources import envelopes
    hdr = envelopes.alert_header(_envelopes(spark, sf_dir))
    out = catalog.service_catalog(hdr)
    return out.select(F.array_join("apps", ",").alias("apps"), F.array_join("services", ",").alias("services"),
                      iso("last_updated").alias("last_updated"))


# ---------------------------------------------------------------- log series

# Dashboard interval used on the driver data.
DRIVER_INTERVAL = "1 hour"


@report("log_totals")
def log_totals(spark, sf_dir):
    from ..operators import logseries
    return logseries.log_totals(views.log_lines_v(spark, sf_dir))


@report("log_level_series")
def log_level_series(spark, sf_dir):
    from ..operators import logseries
    out = logseries.level_series(views.log_lines_v(spark, sf_dir), DRIVER_INTERVAL)
    return out.select(iso("bucket_start").alias("bucket_start"), "info", "warn", "error", "critical")


@report("log_volume_series")
def log_volume_series(spark, sf_dir):
    from ..operators import logseries
    lines = views.log_lines_v(spark, sf_dir).withColumn("filename", F.concat("app", F.lit(".log")))
    out = logseries.volume_series(lines, DRIVER_INTERVAL)
    return out.select("filename", iso("bucket_start").alias("bucket_start"), "lines")


@report("latest_errors")
def latest_errors(spark, sf_dir):
    from ..operators import logseries
    out = logseries.latest_errors(views.log_lines_v(spark, sf_dir), limit=100)
    return out.select("line_id", iso("ts").alias("ts"), "line")


@report("table_counts")
def table_counts(spark, sf_dir):
    from ..operators import logseries
    return logseries.table_counts(
        metrics=views.metrics_v(spark, sf_dir), logs=views.logs_v(spark, sf_dir),
        traces=views.traces_v(spark, sf_dir), cases=views.cases_v(spark, sf_dir),
        alerts=views.alerts_v(spark, sf_dir))


@report("alert_time_buckets")
def alert_time_buckets(spark, sf_dir):
    from ..operators import cases
    keyed = cases.alert_dedup_keys(_breaches(spark, sf_dir), window_seconds=DRIVER_GAP_SECONDS)
    return keyed.groupBy("org_id", "dedup_key").agg(F.count(F.lit(1)).alias("n"),
                                                     iso(F.min("ts")).alias("first_ts"))


# ---------------------------------------------------------------- reads

@report("recent_logs")
def recent_logs(spark, sf_dir):
    from ..operators import reads
    out = reads.recent(views.logs_v(spark, sf_dir), limit=100, org_id="org-1")
    return out.select("id", iso("ts").alias("ts"), "service", "level", "event", "trace_id", "message")


@report("recent_traces")
def recent_traces(spark, sf_dir):
    from ..operators import reads
    out = reads.recent(views.traces_v(spark, sf_dir), limit=50, service="svc-2", org_id="org-0")
    return out.select("id", iso("ts").alias("ts"), "trace_id", "service", "span_name",
                      r6("duration_ms").alias("duration_ms"), "is_error", "error_code")


@report("recent_metrics")
def recent_metrics(spark, sf_dir):
    from ..operators import reads
    out = reads.recent(views.metrics_v(spark, sf_dir), limit=0, service="svc-3")
    return out.select("id", iso("ts").alias("ts"), "service", r6("error_rate").alias("error_rate"),
                      r6("p99_latency_ms").alias("p99_latency_ms"), "active_connections",
                      r6("rss_mb").alias("rss_mb"), "org_id")


@report("trace_by_id")
def trace_by_id(spark, sf_dir):
    from ..operators import reads
    out = reads.trace_by_id(views.traces_v(spark, sf_dir), "t42")
    return out.select("id", iso("ts").alias("ts"), "trace_id", "service", "span_name", "is_error", "error_code")


@report("list_cases")
def list_cases(spark, sf_dir):
    from ..operators import reads
    out = reads.recent(views.cases_v(spark, sf_dir), ts_col="opened_at", limit=100, org_id="org-2",
                       status="OPEN")
    return out.select("id", "org_id", "status", "primary_service", iso("opened_at").alias("opened_at"), iso("updated_at").alias("updated_at"),
                      "severity", "title")


@report("list_alerts")
def list_alerts(spark, sf_dir):
    from ..operators import reads
    out = reads.recent(views.alerts_v(spark, sf_dir), ts_col="triggered_at", limit=100, service="svc-1")
    return _alert_columns(out)


def _alert_columns(df):
    return df.select("id", "case_id", "service", "metric", "severity", iso("triggered_at").alias("triggered_at"),
                      iso("received_at").alias("received_at"), "duplicate_count")


@report("open_cases_with_alerts")
def open_cases_with_alerts(spark, sf_dir):
    from ..operators import reads
    out = reads.open_cases_with_alerts(views.cases_v(spark, sf_dir), views.alerts_v(spark, sf_dir), limit=50,
                                       org_id="org-1")
    return _nested(out)


@report("open_service_cases_with_alerts")
def open_service_cases_with_alerts(spark, sf_dir):
    from ..operators import reads
    return _nested(reads.open_cases_with_alerts(views.cases_v(spark, sf_dir), views.alerts_v(spark, sf_dir),
                                                service="svc-2", org_id="org-1"))


def _nested(out):
    return out.select("id", "status", iso("opened_at").alias("opened_at"),
                      F.size("alerts").cast("bigint").alias("n_alerts"),
                      F.array_join(F.transform("alerts", lambda a: a["alert_id"].cast("string")), ",")
                      .alias("alert_ids"))


# Ids that the by-id reads look up in the driver data.
DRIVER_CASE_ID, DRIVER_ALERT_ID = 7, 60


@report("case_by_id")
def case_by_id(spark, sf_dir):
    from ..operators import reads
    out = reads.by_id(views.cases_v(spark, sf_dir), "id", DRIVER_CASE_ID)
    return out.select("id", "org_id", "status", "primary_service", iso("opened_at").alias("opened_at"), "title")


@report("alerts_of_case")
def alerts_of_case(spark, sf_dir):
    from ..operators import reads
    return _alert_columns(reads.recent(views.alerts_v(spark, sf_dir), ts_col="triggered_at", limit=100,
                                       case_id=DRIVER_CASE_ID))


@report("alert_by_id")
def alert_by_id(spark, sf_dir):
    from ..operators import reads
    return _alert_columns(reads.by_id(views.alerts_v(spark, sf_dir), "id", DRIVER_ALERT_ID))


# ---------------------------------------------------------------- parsing

@report("parse_log_lines")
def parse_log_lines(spark, sf_dir):
    from ..functions import parse
    from ..operators import logparse
    out = logparse.parse_lines(views.log_lines_v(spark, sf_dir))
    return out.select("line_id", "level", "service", "message", "trace_id",
                      parse.context_text("context").alias("context"))


@report("parse_log_context")
def parse_log_context(spark, sf_dir):
    from ..operators import logparse
    out = logparse.context_pairs(views.log_lines_v(spark, sf_dir))
    return out.select("line_id", F.col("pos").cast("bigint").alias("pos"), "key", "value")


@report("slugify_events")
def slugify_events(spark, sf_dir):
    from ..functions import parse
    c = views.cases_v(spark, sf_dir)
    return c.select("id", "title", parse.slug("title").alias("slug"))


def _case_refs(spark, sf_dir):
    from ..functions import parse
    c = views.cases_v(spark, sf_dir)
    ref = (F.when(F.col("id") % 3 == 0, parse.case_label("id"))
           .when(F.col("id") % 3 == 1, F.col("id").cast("string"))
           .otherwise(F.concat(F.lit("CASE-x"), F.col("id").cast("string"))))
    return c.select("id", ref.alias("ref"))


@report("parse_case_ids")
def parse_case_ids(spark, sf_dir):
    from ..functions import parse
    return _case_refs(spark, sf_dir).select("ref", parse.parse_case_id("ref").alias("case_id"))


@report("json_fields")
def json_fields(spark, sf_dir):
    logs = views.logs_v(spark, sf_dir)
    return logs.select("id", F.get_json_object("context", "$.k").cast("bigint").alias("k"),
                       F.size(F.json_object_keys("context")).cast("bigint").alias("n_keys"))


@report("alert_payloads")
def alert_payloads(spark, sf_dir):
    from ..functions import jsonfn, parse
    b = _breaches(spark, sf_dir)
    payload = jsonfn.to_json_keep_nulls(
        F.col("service"), F.col("metric"), F.col("value"), parse.py_isoformat("ts").alias("ts"),
        F.col("severity"), F.col("event"), F.col("message"), F.col("trace_id"))
    return b.select("org_id", "seq", "src_id", "metric", payload.alias("raw_payload"))


def _model_outputs(spark, sf_dir):
    c = views.cases_v(spark, sf_dir)
    title = F.coalesce(F.col("title"), F.lit("untitled"))
    body = F.concat(
        F.lit('{"title":"'), title, F.lit('","hypotheses":[{"rank":1,"text":"'), F.col("primary_service"),
        F.lit(' saturated","confidence":'), (F.col("id") % 100).cast("string"),
        F.lit('}],"evidence":[{"type":"log","label":"'), F.col("status"),
        F.lit('","text":"seen"}],"ai_summary":"'), F.coalesce(F.col("ai_summary"), F.lit("")), F.lit('"}'))
    text = (F.when(F.col("id") % 8 == 7, F.concat(F.lit('{"title": "'), title, F.lit('", ')))
            .when(F.col("id") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(F.col("id") % 4 == 1, body)
            .when(F.col("id") % 4 == 2, F.concat(F.lit("```\n"), body, F.lit("```")))
            .otherwise(F.concat(F.lit("  "), body, F.lit("\n"))))
    return c.select(F.col("id").alias("case_id"), text.alias("response"))


@report("parse_model_json")
def parse_model_json(spark, sf_dir):
    from ..functions import jsonfn
    m = _model_outputs(spark, sf_dir).withColumn("s", jsonfn.parse_summary("response"))
    return m.select("case_id", F.col("s").isNotNull().alias("ok"), F.col("s.title").alias("title"),
                    F.size("s.hypotheses").alias("n_hypotheses"),
                    F.col("s.hypotheses")[0]["text"].alias("first_hypothesis"),
                    F.col("s.hypotheses")[0]["confidence"].alias("confidence"),
                    F.col("s.ai_summary").alias("ai_summary"))


def _envelopes(spark, sf_dir):
    from ..sources import envelopes
    return envelopes.parse_envelopes(views.envelopes_v(spark, sf_dir))


@report("firing_alerts")
def firing_alerts(spark, sf_dir):
    from ..sources import envelopes
    out = envelopes.firing_alerts(_envelopes(spark, sf_dir))
    return out.select("env_id", F.col("pos").cast("bigint").alias("pos"), "status", "alertname", "service", "app")


@report("alert_header")
def alert_header(spark, sf_dir):
    from ..sources import envelopes
    out = envelopes.alert_header(_envelopes(spark, sf_dir))
    return out.select("env_id", "service", "app", "alertname")


@report("alert_to_logs")
def alert_to_logs(spark, sf_dir):
    from ..functions import parse
    from ..sources import envelopes
    out = envelopes.alert_to_logs(_envelopes(spark, sf_dir))
    return out.select("env_id", F.col("pos").cast("bigint").alias("pos"), "level", "service", "event", "message",
                      "trace_id",
                      parse.context_text("context").alias("context"))


# ---------------------------------------------------------------- similarity

@report("vector_topk")
def vector_topk(spark, sf_dir):
    from ..operators import similarity
    v = views.case_vectors_v(spark, sf_dir)
    out = similarity.exact_topk(v, v, 5, q_id="case_id", i_id="case_id", exclude_self=True)
    return out.select(F.col("query_id").alias("case_id"), F.col("rank").cast("bigint").alias("rank"),
                      F.col("match_id").alias("match_id"), r6("score").alias("score"))


@report("dedup_post_filter")
def dedup_post_filter(spark, sf_dir):
    from ..operators import similarity
    v = views.case_vectors_v(spark, sf_dir).select("case_id", "org_id", "service", "vector")
    out = similarity.dedup_post_filter(v, v, threshold=DRIVER_SIMILARITY, exclude_self=True)
    return out.select("case_id", "matched_case_id", r6("score").alias("score"), "is_duplicate")


@report("dedup_pre_filter")
def dedup_pre_filter(spark, sf_dir):
    from ..operators import similarity
    v = views.case_vectors_v(spark, sf_dir).select("case_id", "org_id", "service", "vector")
    out = similarity.dedup_pre_filter(v, v, threshold=DRIVER_SIMILARITY, exclude_self=True)
    return out.select("case_id", "matched_case_id", r6("score").alias("score"), "is_duplicate")


@report("action_match")
def action_match(spark, sf_dir):
    from ..operators import similarity
    v = views.case_vectors_v(spark, sf_dir)
    catalog = similarity.normalized_centroids(v.select("label", "vector"))
    out = similarity.exact_topk(v, catalog, 3, q_id="case_id", i_id="label")
    return out.select(F.col("query_id").alias("case_id"), F.col("rank").cast("bigint").alias("rank"),
                      F.col("match_id").cast("int").alias("action_id"), r6("score").alias("score"))


# ---------------------------------------------------------------- teams, cases, tenancy, traces

def _case_actions(spark, sf_dir):
    return action_match(spark, sf_dir).select(
        "case_id", (F.col("action_id") + 1).cast("int").alias("action_id"),
        F.col("score").cast("decimal(5,4)").alias("similarity_score"))


@report("case_actions_ranked")
def case_actions_ranked(spark, sf_dir):
    from ..functions.catalog_data import actions_frame
    from ..operators import caseview
    out = caseview.ranked_case_actions(_case_actions(spark, sf_dir), actions_frame(spark))
    return out.select("case_id", "action_id", "name", "action_type", r6("similarity_score").alias("score"))


@report("users_with_teams")
def users_with_teams(spark, sf_dir):
    from ..operators import teams
    out = teams.users_with_teams(views.users_v(spark, sf_dir), views.teams_v(spark, sf_dir))
    return out.select("id", "name", "role", "team_name")


@report("team_members")
def team_members(spark, sf_dir):
    u = views.users_v(spark, sf_dir)
    t = views.teams_v(spark, sf_dir).select(F.col("id").alias("team_id"), F.col("org_id").alias("team_org"))
    return (t.join(u, "team_id", "inner").where(F.col("org_id") == F.col("team_org"))
            .select("team_id", F.col("id").alias("user_id"), "name", F.col("role").alias("org_role")))


@report("team_routing")
def team_routing(spark, sf_dir):
    from ..operators import teams
    out = teams.route(views.cases_v(spark, sf_dir), views.teams_v(spark, sf_dir))
    return out.select("id", "team")


def _view_out(df):
    return df.select("inc_id", "title", "severity", "status", F.array_join("services", ",").alias("services"),
                     "team", "ai_summary", "occurrences", "first_seen", "last_seen")


@report("case_view")
def case_view(spark, sf_dir):
    from ..operators import caseview
    return _view_out(caseview.case_view(views.cases_v(spark, sf_dir), views.teams_v(spark, sf_dir)))


@report("case_list")
def case_list(spark, sf_dir):
    from ..operators import caseview
    return _view_out(caseview.case_list(views.cases_v(spark, sf_dir), views.teams_v(spark, sf_dir), "org-1",
                                        ["svc-1", "svc-2"]))


@report("case_detail")
def case_detail(spark, sf_dir):
    from ..functions.catalog_data import actions_frame
    from ..operators import caseview
    req = _case_refs(spark, sf_dir).select("ref", F.concat(F.lit("org-"), (F.col("id") % 3).cast("string"))
                                           .alias("org_id"))
    out = caseview.case_detail(req, views.cases_v(spark, sf_dir), views.teams_v(spark, sf_dir),
                               _case_actions(spark, sf_dir), actions_frame(spark))
    return out.select("ref", "inc_id", "title", "team", F.size("actions").cast("bigint").alias("n_actions"),
                      F.try_element_at("actions", F.lit(1))["name"].alias("top_action"))


@report("case_detail_actions")
def case_detail_actions(spark, sf_dir):
    """Nested actions of all requested cases with their applied state, one row each."""
    from ..functions.catalog_data import actions_frame
    from ..operators import cases, caseview
    req = _case_refs(spark, sf_dir).select("ref", F.concat(F.lit("org-"), (F.col("id") % 3).cast("string")).alias("org_id"))
    out = caseview.case_detail(req, views.cases_v(spark, sf_dir), views.teams_v(spark, sf_dir),
                               cases.apply_to_case_actions(*_applied(spark, sf_dir)), actions_frame(spark))
    return out.select("ref", F.posexplode("actions").alias("pos", "a")).select(
        "ref", "pos", "a.action_id", "a.name", "a.action_type", "a.description", r6("a.similarity_score").alias("score"),
        "a.status", "a.applied_by", iso("a.applied_at").alias("applied_at"), "a.result")


@report("services_for_teams")
def services_for_teams(spark, sf_dir):
    from ..operators import teams
    out = teams.services_for_teams(views.teams_v(spark, sf_dir))
    return out.select("org_id", F.array_join("services", ",").alias("services"))


@report("org_overview")
def org_overview(spark, sf_dir):
    from ..operators import teams
    return teams.org_overview(views.orgs_v(spark, sf_dir), views.teams_v(spark, sf_dir),
                              views.users_v(spark, sf_dir))


@report("org_detail")
def org_detail(spark, sf_dir):
    from ..operators import teams
    out = teams.org_detail(views.orgs_v(spark, sf_dir), views.teams_v(spark, sf_dir), views.users_v(spark, sf_dir))
    return out.select("org_id", F.array_join(F.transform("teams", lambda t: t["name"]), ",").alias("teams"),
                      F.coalesce("user_count", F.lit(0)).alias("user_count"),
                      F.col("first_user.name").alias("first_user"))


@report("org_entries")
def org_entries(spark, sf_dir):
    from ..operators import teams
    out = teams.org_entries(views.orgs_v(spark, sf_dir), views.teams_v(spark, sf_dir), views.users_v(spark, sf_dir))
    return out.withColumn("services", F.array_join("services", ","))


@report("case_view_timeline")
def case_view_timeline(spark, sf_dir):
    """Views of the cases that commands have resolved, with their timelines, one row per entry."""
    from ..operators import cases, caseview
    c = views.cases_v(spark, sf_dir)
    entries = cases.resolution_entries(c, _resolve_commands(spark, sf_dir)).withColumn("seq", F.lit(0))
    view = caseview.case_view(caseview.with_timeline(c, entries), views.teams_v(spark, sf_dir))
    return view.select("inc_id", "team", F.size("evidence").alias("n_evidence"), F.size("cascades").alias("n_cascades"),
                       F.posexplode("timeline").alias("pos", "e")).select(
        "inc_id", "team", "n_evidence", "n_cascades", "pos", "e.time", "e.event", "e.color")


@report("visible_cases")
def visible_cases(spark, sf_dir):
    from ..operators import teams
    return teams.visible_case_counts(views.users_v(spark, sf_dir), views.teams_v(spark, sf_dir),
                                     views.cases_v(spark, sf_dir))


@report("service_overlap")
def service_overlap(spark, sf_dir):
    t = views.teams_v(spark, sf_dir)
    return t.where(F.arrays_overlap("services", F.array(F.lit("svc-1"), F.lit("svc-3")))).select("id", "name")


@report("log_selector")
def log_selector(spark, sf_dir):
    from ..operators import logseries
    lines = views.log_lines_v(spark, sf_dir)
    return lines.where(logseries.label_regex(F.col("app"), "app-0|gateway") & (F.col("org_id") == "org-1")) \
        .select("line_id", "app")


@report("log_line_contains")
def log_line_contains(spark, sf_dir):
    from ..operators import logseries
    lines = views.log_lines_v(spark, sf_dir)
    return lines.where(logseries.line_contains(F.col("line"), "value=1")).select("line_id")


@report("log_line_regex")
def log_line_regex(spark, sf_dir):
    from ..operators import logseries
    lines = views.log_lines_v(spark, sf_dir)
    return lines.where(logseries.line_regex(F.col("line"), "ERROR|CRITICAL")).select("line_id", "app")


def _resolved_requests(spark, sf_dir):
    from ..operators import tenancy
    return tenancy.resolve_requests(views.ingest_requests_v(spark, sf_dir), views.ingest_keys_v(spark, sf_dir),
                                    views.teams_v(spark, sf_dir))


@report("resolve_ingestion_keys")
def resolve_ingestion_keys(spark, sf_dir):
    from ..operators import tenancy
    out = tenancy.key_usage(_resolved_requests(spark, sf_dir))
    return out.select("key_id", F.col("key_org").alias("org_id"), "n_requests",
                      iso("last_used_at").alias("last_used_at"))


@report("rejected_ingestion")
def rejected_ingestion(spark, sf_dir):
    r = _resolved_requests(spark, sf_dir)
    return r.where(F.col("status").isin("unknown", "revoked")).select("request_id", F.col("status").alias("reason"))


@report("assign_org")
def assign_org(spark, sf_dir):
    from ..operators import tenancy
    return tenancy.write_org(_resolved_requests(spark, sf_dir)).select("request_id", "org_id")


@report("tenant_scope")
def tenant_scope(spark, sf_dir):
    from ..operators import tenancy
    scoped = tenancy.read_scope(_resolved_requests(spark, sf_dir))
    per_org = views.logs_v(spark, sf_dir).groupBy("org_id").agg(F.count(F.lit(1)).alias("n"))
    # a NULL-org row holds the all-orgs total, matched null-safely by unscoped (trusted) reads
    scopes = per_org.unionByName(per_org.agg(F.lit(None).cast("string").alias("org_id"), F.sum("n").alias("n")))
    out = scoped.join(scopes, scoped.read_org.eqNullSafe(scopes.org_id), "left")
    return out.select("request_id", "read_org", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_visible_logs"))


@report("trace_rollup")
def trace_rollup(spark, sf_dir):
    from ..operators import traces
    out = traces.trace_rollup(views.traces_v(spark, sf_dir))
    return out.select("org_id", "trace_id", "n_spans", "n_errors", r6("total_ms").alias("total_ms"),
                      "first_error_service", "slowest_span")


@report("log_span_join")
def log_span_join(spark, sf_dir):
    from ..operators import traces
    out = traces.logs_with_trace(views.logs_v(spark, sf_dir), views.traces_v(spark, sf_dir))
    return out.select("id", "trace_id", "n_spans", "n_errors", "slowest_span")


@report("cascade_candidates")
def cascade_candidates(spark, sf_dir):
    from ..operators import traces
    return traces.cascade_candidates(views.traces_v(spark, sf_dir), views.cases_v(spark, sf_dir))


@report("declared_cascades")
def declared_cascades(spark, sf_dir):
    """Every fourth log and every sixth span of the driver data names the service after its own."""
    from ..operators import traces
    nxt = F.concat(F.lit('{"downstream_service":"svc-'), ((F.substring("service", 5, 9).cast("int") + 1) % 5).cast("string"),
                   F.lit('"}'))
    lg = views.logs_v(spark, sf_dir).withColumn("context", F.when(F.col("id") % 4 == 0, nxt).otherwise(F.lit("{}")))
    tr = views.traces_v(spark, sf_dir).withColumn("attributes", F.when(F.col("id") % 6 == 0, nxt).otherwise(F.lit("{}")))
    return traces.cascade_candidates(tr, views.cases_v(spark, sf_dir), traces.declared_edges(lg, tr))


@report("log_own_span")
def log_own_span(spark, sf_dir):
    from ..operators import traces
    lg = views.logs_v(spark, sf_dir).withColumn("trace_id", F.when(F.col("id") % 5 != 0, F.col("trace_id")))
    out = traces.logs_with_span(lg, views.traces_v(spark, sf_dir))
    return out.select("id", "trace_id", "service", "span_name", r6("duration_ms").alias("duration_ms"), "is_error",
                      "error_code")


@report("cofailure_pairs")
def cofailure_pairs(spark, sf_dir):
    from ..operators import traces
    return traces.cofailure_pairs(views.traces_v(spark, sf_dir))


@report("case_kpis")
def case_kpis(spark, sf_dir):
    c = views.cases_v(spark, sf_dir)
    return c.groupBy("org_id").agg(F.count_if(F.col("status") != "RESOLVED").alias("open"),
                                   F.count_if(F.col("status") == "RESOLVED").alias("resolved"),
                                   F.count_if(F.col("occurrence_count") > 1).alias("recurring"))


# ---------------------------------------------------------------- case state and context

# Replay parameters for the driver data.
DRIVER_LOOKBACK_SECONDS = 21600.0
DRIVER_AS_OF = "2024-02-01 00:00:00"


def _groups(spark, sf_dir):
    return signature.session_signatures(_breaches(spark, sf_dir), DRIVER_GAP_SECONDS)


def _opened(spark, sf_dir):
    from ..operators import cases
    return cases.open_cases(_groups(spark, sf_dir))


@report("open_cases")
def open_cases(spark, sf_dir):
    out = _opened(spark, sf_dir)
    return out.select("org_id", "primary_service", iso("opened_at").alias("opened_at"),
                      iso("updated_at").alias("updated_at"), "status", "occurrence_count", "severity",
                      "signature_text", F.col("timeline")[0]["time"].alias("opened_time"))


def _matches(spark, sf_dir):
    a = views.alerts_v(spark, sf_dir)
    score = ((F.lit(86) + F.col("quantity").cast("int") % 10).cast("decimal(10,0)") / 100).cast("decimal(5,4)")
    return a.select("case_id", score.alias("score"), F.col("received_at").alias("at"), F.col("id").alias("seq"),
                    "severity")


@report("recur_cases")
def recur_cases(spark, sf_dir):
    from ..operators import cases
    out = cases.recur_cases(views.cases_v(spark, sf_dir), _matches(spark, sf_dir))
    return out.select("id", "status", "occurrence_count", r6("similarity_score").alias("score"),
                      iso("updated_at").alias("updated_at"), "severity", iso("summarized_at").alias("summarized_at"),
                      iso("matched_at").alias("matched_at"))


def _alert_state_schema():
    return ("id bigint, case_id bigint, service string, metric string, severity string, triggered_at timestamp, "
            "source_tool string, duplicate_count int, received_at timestamp")


def _rolled_alerts(spark, sf_dir):
    from ..operators import cases
    empty = spark.createDataFrame([], _alert_state_schema())
    return cases.alert_rollup(empty, views.alerts_v(spark, sf_dir))


@report("alert_rollup")
def alert_rollup(spark, sf_dir):
    out = _rolled_alerts(spark, sf_dir)
    return out.select("id", "case_id", "service", "metric", "severity", iso("triggered_at").alias("triggered_at"),
                      "duplicate_count", iso("received_at").alias("received_at"))


# Alerts before this day are the known state, the later ones a batch.
DRIVER_ALERT_SPLIT = "1996-01-01"


@report("alert_rollup_update")
def alert_rollup_update(spark, sf_dir):
    from ..operators import cases
    a = views.alerts_v(spark, sf_dir).withColumns({
        "org_id": F.concat(F.lit("org-"), (F.col("case_id") % 3).cast("string")),
        "raw_payload": F.concat(F.lit('{"q":'), F.col("quantity").cast("int").cast("string"), F.lit("}"))})
    empty = spark.createDataFrame([], _alert_state_schema() + ", org_id string, raw_payload string")
    known = cases.alert_rollup(empty, a.where(F.col("triggered_at") < DRIVER_ALERT_SPLIT))
    out = cases.alert_rollup(known, a.where(F.col("triggered_at") >= DRIVER_ALERT_SPLIT))
    return out.select("id", "org_id", "case_id", "service", "metric", "severity", "raw_payload",
                      iso("triggered_at").alias("triggered_at"), "duplicate_count",
                      iso("received_at").alias("received_at"))


@report("case_timeline")
def case_timeline(spark, sf_dir):
    from ..operators import cases
    a = _rolled_alerts(spark, sf_dir)
    # alert ids of the driver data repeat, so service and metric complete the order
    entries = a.select("case_id", F.col("triggered_at").alias("at"), F.struct("id", "service", "metric").alias("seq"),
                       F.date_format("triggered_at", "HH:mm:ss").alias("time"),
                       F.concat(F.lit("Alert "), F.col("metric"), F.lit(" on "), F.col("service"), F.lit(" ("),
                                F.col("severity"), F.lit(")")).alias("event"),
                       F.when(F.col("severity") == "critical", "#f87171").otherwise("#fbbf24").alias("color"))
    t = cases.fold_timeline(entries)
    return t.select("case_id", F.size("timeline").alias("n_entries"),
                    F.col("timeline")[0]["event"].alias("first_event"),
                    F.array_join(F.transform("timeline", lambda e: F.concat(e["time"], F.lit(" "), e["event"])),
                                 "; ").alias("timeline_text"))


def _summaries(spark, sf_dir):
    from ..functions import jsonfn
    return _model_outputs(spark, sf_dir).select(
        "case_id", jsonfn.parse_summary("response").alias("s"), F.lit(DRIVER_AS_OF).cast("timestamp").alias("at"))


@report("save_summaries")
def save_summaries(spark, sf_dir):
    from ..operators import cases
    c = views.cases_v(spark, sf_dir)
    queued = c.where(F.col("summarized_at").isNull())
    out = cases.save_summaries(queued, _summaries(spark, sf_dir))
    return out.select("id", "title", "ai_summary", F.col("summarized_at").isNotNull().alias("summarized"),
                      iso("summarized_at").alias("summarized_at"))


def _resolve_commands(spark, sf_dir):
    a = views.alerts_v(spark, sf_dir)
    return a.where(F.col("metric") == "R").select(
        "case_id", F.concat(F.lit("org-"), (F.col("id") % 3).cast("string")).alias("org_id"),
        F.col("received_at").alias("at"))


@report("resolve_cases")
def resolve_cases(spark, sf_dir):
    from ..operators import cases
    out = cases.resolve_cases(views.cases_v(spark, sf_dir), _resolve_commands(spark, sf_dir))
    return out.where(F.col("resolve_commands") > 0).select("id", "status", iso("updated_at").alias("updated_at"),
                                                           "resolve_commands")


@report("resolved_timeline")
def resolved_timeline(spark, sf_dir):
    from ..operators import cases
    out = cases.resolution_entries(views.cases_v(spark, sf_dir), _resolve_commands(spark, sf_dir))
    return out.select("case_id", "org_id", iso("at").alias("at"), "time", "event", "color")


@report("apply_actions")
def apply_actions(spark, sf_dir):
    from ..functions.catalog_data import actions_frame
    from ..operators import cases
    ca = _case_actions(spark, sf_dir)
    cmds = ca.select("case_id").distinct().select(
        "case_id", F.concat(F.lit("org-"), (F.col("case_id") % 3).cast("string")).alias("org_id"),
        (F.col("case_id") % 10 + 1).cast("int").alias("action_id"),
        F.lit(DRIVER_AS_OF).cast("timestamp").alias("at"))
    out = cases.apply_actions(cmds, views.cases_v(spark, sf_dir), ca, actions_frame(spark))
    return out.select("case_id", "action_id", "outcome", "action_type", "new_status")


def _applied(spark, sf_dir):
    from ..functions.catalog_data import actions_frame
    from ..operators import cases
    ca = _case_actions(spark, sf_dir)
    cmds = ca.select("case_id", "action_id").where(F.col("case_id") % 2 == 0).distinct().select(
        "case_id", F.concat(F.lit("org-"), (F.col("case_id") % 4).cast("string")).alias("org_id"), "action_id",
        F.timestamp_seconds(F.unix_seconds(F.lit(DRIVER_AS_OF).cast("timestamp")) + F.col("action_id")).alias("at"),
        F.concat(F.lit("u"), F.col("action_id").cast("string")).alias("user_id"),
        F.concat(F.lit("https://example.org/pr/"), F.col("case_id").cast("string")).alias("pr_url"))
    return ca, cases.applied_results(cases.apply_actions(cmds, views.cases_v(spark, sf_dir), ca, actions_frame(spark)))


@report("applied_case_actions")
def applied_case_actions(spark, sf_dir):
    from ..operators import cases
    out = cases.apply_to_case_actions(*_applied(spark, sf_dir))
    return out.select("case_id", "action_id", "status", "applied_by", iso("applied_at").alias("applied_at"), "result")


@report("applied_cases")
def applied_cases(spark, sf_dir):
    from ..operators import cases
    out = cases.apply_to_cases(views.cases_v(spark, sf_dir), _applied(spark, sf_dir)[1])
    return out.select("id", "status", iso("updated_at").alias("updated_at"))


@report("applied_timeline")
def applied_timeline(spark, sf_dir):
    return _applied(spark, sf_dir)[1].select("case_id", "action_id", F.posexplode("entries").alias("pos", "e")).select(
        "case_id", "action_id", "pos", "e.event", "e.color")


@report("work_queues")
def work_queues(spark, sf_dir):
    from ..operators import cases
    return cases.work_queues(views.cases_v(spark, sf_dir)).select("id", "queue")


@report("case_context_logs")
def case_context_logs(spark, sf_dir):
    from ..operators import context
    out = context.case_context_logs(_opened(spark, sf_dir), views.logs_v(spark, sf_dir))
    return out.select("org_id", "service", iso("opened_at").alias("opened_at"), "log_id", iso("ts").alias("ts"))


@report("case_context_alerts")
def case_context_alerts(spark, sf_dir):
    from ..operators import context
    out = context.case_context_alerts(views.cases_v(spark, sf_dir), views.alerts_v(spark, sf_dir))
    return out.select("case_id", "id", iso("triggered_at").alias("triggered_at"), "metric", "severity")


@report("recurrence_candidates")
def recurrence_candidates(spark, sf_dir):
    from ..operators import context
    g = _groups(spark, sf_dir)
    cases = _opened(spark, sf_dir).withColumnRenamed("primary_service", "service")
    out = context.recurrence_candidates(g, cases, lookback_seconds=DRIVER_LOOKBACK_SECONDS)
    return out.select("org_id", "service", iso("first_ts").alias("first_ts"),
                      iso("cand_opened_at").alias("cand_opened_at"))


def _case_alerts_from_breaches(spark, sf_dir):
    """Breaches as alert rows of the case their group opened, rolled up per (case, service, metric)."""
    from ..operators import cases
    g = _grouped(spark, sf_dir)
    batch = g.select(
        F.xxhash64("org_id", "service", "group_start").alias("case_id"), "service", "metric", "severity",
        F.col("ts").alias("triggered_at"), F.col("ts").alias("received_at"),
        (F.col("src_id") * 16 + F.col("seq") * 3 + F.col("sub")).alias("id"),
        F.lit("stage1_poller").alias("source_tool"))
    return cases.alert_rollup(spark.createDataFrame([], _alert_state_schema()), batch)


def _prompts(spark, sf_dir):
    from ..operators import context
    opened = _opened(spark, sf_dir)
    logs = context.case_context_logs(opened, views.logs_v(spark, sf_dir))
    return opened, context.case_prompt(opened, _case_alerts_from_breaches(spark, sf_dir), logs)


@report("case_prompt")
def case_prompt(spark, sf_dir):
    opened, p = _prompts(spark, sf_dir)
    out = p.join(opened.select(F.col("id").alias("case_id"), "org_id", "primary_service", "opened_at"), "case_id")
    return out.select("org_id", "primary_service", iso("opened_at").alias("opened_at"), "n_alerts", "n_logs",
                      "prompt")


@report("summary_prompts")
def summary_prompts(spark, sf_dir):
    """What the model is sent for each case that waits for a summary."""
    from ..operators import cases, context
    waiting = views.cases_v(spark, sf_dir).where("summarized_at IS NULL")
    alerts = views.alerts_v(spark, sf_dir).join(waiting.select(F.col("id").alias("case_id")), "case_id", "left_semi").withColumns({
        "org_id": F.concat(F.lit("org-"), (F.col("case_id") % 3).cast("string")),
        "raw_payload": F.concat(F.lit('{"q":'), F.col("quantity").cast("int").cast("string"), F.lit("}"))})
    rolled = cases.alert_rollup(alerts.limit(0), alerts)
    return context.summary_prompt(waiting, rolled, context.case_context_logs(waiting, views.logs_v(spark, sf_dir)))


@report("summarize_cases")
def summarize_cases(spark, sf_dir):
    from ..operators import context
    opened, p = _prompts(spark, sf_dir)
    s = context.summarize_cases(p)
    out = s.join(opened.select(F.col("id").alias("case_id"), "org_id", "primary_service", "opened_at"), "case_id")
    return out.select("org_id", "primary_service", iso("opened_at").alias("opened_at"),
                      F.col("s").isNotNull().alias("ok"), F.col("s.title").alias("title"))


def _case_client(batches):
    """A model that answers by case id: well, in fences, badly once, badly twice, incompletely or not at all."""
    import json

    import pandas as pd

    from ..operators import context

    def answer(case_id: int, strict: bool) -> str | None:
        if case_id % 13 == 5:
            return None
        if case_id % 11 == 3:
            return json.dumps({"title": f"case {case_id}", "hypotheses": [], "ai_summary": "no evidence"})
        if case_id % 8 == 7 and (not strict or case_id % 16 == 15):
            return f'{{"title": "case {case_id}'
        body = json.dumps({"title": f"case {case_id}", "hypotheses": [{"rank": 1, "text": "load", "confidence": case_id % 100}],
                           "evidence": [], "ai_summary": "short" if strict else "full"})
        return f"```json\n{body}\n```" if case_id % 2 else body

    for pdf in batches:
        strict = pdf["prompt"].str.endswith(context.STRICT_SUFFIX)
        yield pd.DataFrame({"case_id": pdf["case_id"],
                            "response": [answer(int(i), bool(s)) for i, s in zip(pdf["case_id"], strict)]})


@report("model_answers")
def model_answers(spark, sf_dir):
    from ..operators import context
    prompts = views.cases_v(spark, sf_dir).select(
        F.col("id").alias("case_id"), F.concat(F.lit("CASE\nservice="), "primary_service").alias("prompt"))
    out = context.model_answers(prompts, _case_client)
    return out.select("case_id", "outcome", "reason", "rounds", F.col("s.title").alias("title"),
                      F.col("s.hypotheses")[0]["confidence"].alias("confidence"), F.col("s.ai_summary").alias("ai_summary"))


@report("upload_context")
def upload_context(spark, sf_dir):
    from pyspark.sql import Window

    from ..functions import parse
    docs = views.log_files_v(spark, sf_dir).select(
        "doc_id", F.col("line").alias("text"), F.concat(F.lit("org-"), (F.col("doc_id") % 3).cast("string"))
        .alias("org_id"))
    c = views.cases_v(spark, sf_dir).where(F.col("status") != "RESOLVED")
    w = Window.partitionBy("org_id").orderBy(F.col("updated_at").desc_nulls_first(), F.col("id").desc())
    top = c.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 20)
    inc = top.groupBy("org_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "rn", F.concat(F.lit("- "), parse.case_label("id"), F.lit(": "), F.coalesce("title", F.lit("None")),
                       F.lit(" | "), F.coalesce("severity", F.lit("None")), F.lit(" | "),
                       F.coalesce("ai_summary", F.lit("None"))).alias("t")))), lambda x: x["t"]).alias("lines"))
    j = docs.join(F.broadcast(inc), "org_id", "left")  # a row of at most 20 lines for each of three orgs; texts stay in place
    section = F.when(F.coalesce(F.size("lines"), F.lit(0)) > 0,
                     F.concat(F.lit("CURRENTLY OPEN INCIDENTS:\n"), F.array_join("lines", "\n"))) \
        .otherwise(F.lit("CURRENTLY OPEN INCIDENTS: none"))
    ctx = F.concat(F.lit("RAW LOG TEXT (unparsed):\n"), F.col("text"), F.lit("\n\n"), section)
    return j.select("doc_id", "org_id", F.length(ctx).alias("n_chars"),
                    F.sha2(ctx, 256).alias("context_sha256"))


@report("remediation_notes")
def remediation_notes(spark, sf_dir):
    from ..functions.catalog_data import actions_frame
    from ..operators import caseview, context
    c = views.cases_v(spark, sf_dir)
    s = _summaries(spark, sf_dir).select("case_id", F.col("s.hypotheses").alias("hypotheses"))
    ranked = caseview.ranked_case_actions(_case_actions(spark, sf_dir), actions_frame(spark))
    top = ranked.groupBy("case_id").agg(F.min_by(F.struct("name", "description"), F.struct(
        (-F.col("similarity_score")).alias("ns"), F.col("action_id"))).alias("a"))
    j = c.join(top, c.id == top.case_id, "inner").drop("case_id").join(s, c.id == s.case_id, "left")
    note = context.remediation_note(F.col("id"), F.col("primary_service"), F.col("title"), F.col("ai_summary"),
                                    F.col("a.name"), F.col("a.description"), F.col("hypotheses"))
    return j.select(F.col("id").alias("case_id"), note.alias("note"))


# ---------------------------------------------------------------- ingest

# Caps used on the driver data by the guard report, the clients (rows in a body) and
# the refusal report (a server that takes fewer rows than the clients send).
DRIVER_BATCH_CAP = 3
DRIVER_BODY_ROWS = 40
DRIVER_SMALL_CAP = 35


def _day_batches(df):
    return df.withColumn("batch_day", F.to_date("ts"))


def _bodies(spark, sf_dir, kind):
    """Client side: bodies of one kind of rows and the schema of their entries."""
    from ..sources import ingest
    if kind == "logs":
        src = _day_batches(views.logs_v(spark, sf_dir)).withColumn("batch_user", F.col("org_id"))
        entry = F.struct(F.col("service"), F.col("level"), F.col("event"), F.col("trace_id").alias("traceId"),
                         F.col("message"), F.from_json("context", "map<string,string>").alias("context"),
                         F.col("org_id").alias("orgId"))
        schema = ingest.LOG_ENTRY
    elif kind == "traces":
        src = _day_batches(views.traces_v(spark, sf_dir)).withColumn("batch_user", F.col("org_id"))
        entry = F.struct(F.col("trace_id").alias("traceId"), F.col("service"), F.col("span_name").alias("spanName"),
                         F.col("duration_ms").alias("durationMs"), F.col("is_error").alias("isError"),
                         F.col("error_code").alias("errorCode"),
                         F.from_json("attributes", "map<string,string>").alias("attributes"),
                         F.col("org_id").alias("orgId"))
        schema = ingest.SPAN_ENTRY
    else:
        src = _day_batches(views.metrics_v(spark, sf_dir)).withColumn("batch_user", F.col("org_id"))
        entry = F.struct(F.col("service"), F.col("error_rate").alias("errorRate"),
                         F.col("p99_latency_ms").alias("p99LatencyMs"),
                         F.col("active_connections").alias("activeConnections"), F.col("rss_mb").alias("rssMb"),
                         F.col("org_id").alias("orgId"))
        schema = ingest.METRIC_ENTRY
    keys = ["batch_user", "batch_day"]
    numbered = ingest.number_bodies(src, keys, "id", cap=DRIVER_BODY_ROWS)
    return ingest.build_bodies(numbered, [*keys, "body_no"], entry), schema


def _ingested(spark, sf_dir, kind):
    from ..sources import ingest
    return ingest.parse_bodies(*_bodies(spark, sf_dir, kind))


@report("ingest_refused")
def ingest_refused(spark, sf_dir):
    """Bodies that a server with a lower cap refuses; every seventh body of a batch lacks a service."""
    from ..sources import ingest
    bodies, schema = _bodies(spark, sf_dir, "metrics")
    damaged = F.when(F.col("body_no") % 7 == 1, F.regexp_replace("body", '"service"', '"svc"'))
    cut = F.when(F.col("body_no") % 7 == 2, F.substring("body", 1, 20))
    out = ingest.refused_bodies(bodies.withColumn("body", F.coalesce(damaged, cut, "body")), schema,
                                cap=DRIVER_SMALL_CAP)
    return out.select("batch_user", F.col("batch_day").cast("string").alias("batch_day"), "body_no", "reason", "n_rows")


@report("ingest_cases")
def ingest_cases(spark, sf_dir):
    from ..sources import ingest
    c = views.cases_v(spark, sf_dir)
    entry = F.struct("status", F.col("primary_service").alias("primaryService"), F.col("opened_at").alias("openedAt"),
                     F.col("signature_text").alias("signatureText"), F.col("similarity_score").alias("similarityScore"),
                     F.when(F.col("id") % 2 == 0, F.col("occurrence_count")).alias("occurrenceCount"), "severity",
                     F.when(F.col("id") % 3 > 0, F.col("org_id")).alias("orgId"))
    numbered = ingest.number_bodies(c.withColumn("batch_org", F.col("org_id")), ["batch_org"], "id", ts_col="opened_at",
                                    cap=DRIVER_BODY_ROWS, bucket_seconds=7 * 86400.0)
    bodies = ingest.build_bodies(numbered, ["batch_org", "body_no"], entry, received_col="updated_at")
    e = ingest.parse_bodies(bodies, ingest.CASE_ENTRY)
    return e.select("batch_org", "body_no", F.col("pos").cast("bigint").alias("pos"),
                    F.coalesce("entry.status", F.lit("OPEN")).alias("status"),
                    F.col("entry.primaryService").alias("primary_service"),
                    iso(F.coalesce("entry.openedAt", "received_at")).alias("opened_at"),
                    F.col("entry.signatureText").alias("signature_text"), r6("entry.similarityScore").alias("score"),
                    F.coalesce("entry.occurrenceCount", F.lit(1)).alias("occurrence_count"),
                    F.col("entry.severity").alias("severity"),
                    F.coalesce("entry.orgId", F.lit("org-default")).alias("org_id"))


@report("ingest_logs")
def ingest_logs(spark, sf_dir):
    from ..functions import parse
    e = _ingested(spark, sf_dir, "logs")
    return e.select("batch_user", F.col("batch_day").cast("string").alias("batch_day"), "body_no",
                    F.col("pos").cast("bigint").alias("pos"),
                    F.col("entry.service").alias("service"), F.col("entry.level").alias("level"),
                    F.col("entry.event").alias("event"), F.col("entry.traceId").alias("trace_id"),
                    F.col("entry.message").alias("message"),
                    parse.context_text(F.col("entry.context")).alias("context"),
                    F.coalesce(F.col("entry.orgId"), F.lit("org-default")).alias("org_id"),
                    iso("received_at").alias("ts"))


@report("ingest_traces")
def ingest_traces(spark, sf_dir):
    e = _ingested(spark, sf_dir, "traces")
    return e.select("batch_user", F.col("batch_day").cast("string").alias("batch_day"), "body_no",
                    F.col("pos").cast("bigint").alias("pos"),
                    F.col("entry.traceId").alias("trace_id"), F.col("entry.service").alias("service"),
                    F.col("entry.spanName").alias("span_name"), r6("entry.durationMs").alias("duration_ms"),
                    F.col("entry.isError").alias("is_error"), F.col("entry.errorCode").alias("error_code"),
                    iso("received_at").alias("ts"))


@report("ingest_metrics")
def ingest_metrics(spark, sf_dir):
    e = _ingested(spark, sf_dir, "metrics")
    return e.select("batch_user", F.col("batch_day").cast("string").alias("batch_day"), "body_no",
                    F.col("pos").cast("bigint").alias("pos"),
                    F.col("entry.service").alias("service"), r6("entry.errorRate").alias("error_rate"),
                    r6("entry.p99LatencyMs").alias("p99_latency_ms"),
                    F.col("entry.activeConnections").alias("active_connections"),
                    r6("entry.rssMb").alias("rss_mb"), iso("received_at").alias("ts"))


@report("ingest_alerts")
def ingest_alerts(spark, sf_dir):
    from ..sources import ingest
    a = views.alerts_v(spark, sf_dir)
    entry = F.struct(F.col("case_id").alias("caseId"), F.col("source_tool").alias("sourceTool"),
                     F.col("service"), F.col("metric"), F.col("severity"),
                     F.col("triggered_at").alias("triggeredAt"),
                     F.when(F.col("id") % 2 == 0, F.col("duplicate_count")).alias("duplicateCount"))
    # alert ids of the driver data repeat: order entries by the whole row
    a = a.withColumn("batch_case", F.col("case_id")).withColumn(
        "_ord", F.struct("id", "case_id", "source_tool", "service", "metric", "severity", "triggered_at"))
    a = ingest.number_bodies(a, ["batch_case"], "_ord", ts_col="triggered_at", cap=DRIVER_BATCH_CAP,
                             bucket_seconds=400 * 86400.0)
    bodies = ingest.build_bodies(a, ["batch_case", "body_no"], entry, received_col="received_at")
    e = ingest.parse_bodies(bodies, ingest.ALERT_ENTRY)
    return e.select("batch_case", "body_no", F.col("pos").cast("bigint").alias("pos"), F.col("entry.service").alias("service"),
                    F.col("entry.metric").alias("metric"), F.col("entry.severity").alias("severity"),
                    iso("entry.triggeredAt").alias("triggered_at"),
                    F.coalesce(F.col("entry.duplicateCount"), F.lit(1)).alias("duplicate_count"),
                    iso("received_at").alias("received_at"))


@report("ingest_batch_guard")
def ingest_batch_guard(spark, sf_dir):
    from ..sources import ingest
    ev = views.table(spark, sf_dir, "events")
    src = ev.select(F.col("user_id").alias("batch_user"), F.to_date(F.col("ts").cast("timestamp")).alias("batch_day"))
    out = ingest.batch_guard(src, ["batch_user", "batch_day"], DRIVER_BATCH_CAP)
    return out.select("batch_user", F.col("batch_day").cast("string").alias("batch_day"), "n_rows", "accepted")


# Replay checkpoint for the incremental scan.
DRIVER_CHECKPOINT = "2024-01-29 00:00:00"


@report("incremental_scan")
def incremental_scan(spark, sf_dir):
    cp = F.lit(DRIVER_CHECKPOINT).cast("timestamp")
    m = views.metrics_v(spark, sf_dir).where(F.col("ts") > cp).select(F.lit("metrics").alias("src"), "id", "ts")
    lg = views.logs_v(spark, sf_dir).where(F.col("ts") > cp).select(F.lit("logs").alias("src"), "id", "ts")
    return m.unionByName(lg).select("src", "id", iso("ts").alias("ts"))


@report("high_water_mark")
def high_water_mark(spark, sf_dir):
    m = views.metrics_v(spark, sf_dir).agg(F.max("ts").alias("m"))
    lg = views.logs_v(spark, sf_dir).agg(F.max("ts").alias("l"))
    both = m.unionByName(lg.withColumnRenamed("l", "m"))
    return both.agg(iso(F.max("m")).alias("max_ts"))


# ---------------------------------------------------------------- cooldown and streams

# Cooldown used on the driver data (events per key are hours apart).
DRIVER_COOLDOWN_SECONDS = 21600.0


def _wanted_alerts(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events")
    return ev.select(views._org("user_id").alias("org_id"), views._svc("user_id").alias("service"),
                     F.col("event_type").alias("alert"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"))


def _fired_out(df):
    return df.select("org_id", "service", "alert", "id", iso(F.timestamp_micros("us")).alias("ts"))


@report("alert_cooldown")
def alert_cooldown(spark, sf_dir):
    from ..operators import cooldown
    fired = cooldown.fired_alerts(_wanted_alerts(spark, sf_dir), ["org_id", "service", "alert"],
                                  DRIVER_COOLDOWN_SECONDS)
    return _fired_out(fired)


@report("stream_cooldown")
def stream_cooldown(spark, sf_dir):
    from ..streaming import jobs
    return _fired_out(jobs.stream_cooldown(spark, sf_dir, DRIVER_COOLDOWN_SECONDS))


@report("stream_detect")
def stream_detect(spark, sf_dir):
    from ..streaming import jobs
    trend = {"window_seconds": detect._seconds(DRIVER_TREND_WINDOW), "slide_seconds": detect._seconds(DRIVER_TREND_SLIDE),
             "slope_mb_per_min": DRIVER_TREND_SLOPE, "min_mb": DRIVER_TREND_MIN_MB}
    return _breach_out(jobs.stream_detect(spark, sf_dir, trend))


@report("stream_breach_sessions")
def stream_breach_sessions(spark, sf_dir):
    from ..streaming import jobs
    out = jobs.stream_breach_sessions(spark, sf_dir, DRIVER_GAP_SECONDS)
    return out.select("org_id", "service", iso("first_ts").alias("first_ts"), iso("last_ts").alias("last_ts"),
                      "n_breaches", "severity", F.array_join("metrics", ",").alias("metrics"))


# ---------------------------------------------------------------- embeddings (rows-only checks)

def _vec_stats(col):
    return (F.size(F.filter(col, lambda x: x != 0)).alias("nnz"),
            F.round(F.sqrt(F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x * x)), 6).alias("norm"))


@report("embed_text")
def embed_text(spark, sf_dir):
    from ..operators import embed
    d = views.log_files_v(spark, sf_dir).select("doc_id", F.col("line").alias("text"))
    out = embed.embed_text(d, "text")
    return out.select("doc_id", *_vec_stats(F.col("vector")))


@report("rebuild_vectors")
def rebuild_vectors(spark, sf_dir):
    from ..operators import embed
    out = embed.rebuild_vectors(_opened(spark, sf_dir))
    return out.select("org_id", "primary_service", *_vec_stats(F.col("vector")))


@report("action_match_text")
def action_match_text(spark, sf_dir):
    from ..functions.catalog_data import actions_frame
    from ..operators import embed
    c = views.cases_v(spark, sf_dir).where(F.col("summarized_at").isNotNull() & F.col("matched_at").isNull())
    out = embed.match_actions(c, actions_frame(spark))
    return out.select("case_id", "rank", "action_id", r6("score").alias("score"))


# ---------------------------------------------------------------- files, incidents, context fetch

def _doc_files(spark, sf_dir):
    from ..sources import files
    from ..streaming import jobs
    path = jobs.run_folder(spark, "logfiles")
    d = views.log_files_v(spark, sf_dir)
    return files.write_log_files(d, path, "filename", "line")


@report("tail_log_files")
def tail_log_files(spark, sf_dir):
    from ..sources import files
    from ..streaming import jobs
    path = _doc_files(spark, sf_dir)
    out, ck = jobs.run_folder(spark, "tail-out"), jobs.run_folder(spark, "tail-ckpt")
    jobs.run_available(files.tail_log_files(spark, path), out, ck)
    lines = jobs.read_batches(spark, out)
    return lines.select(F.regexp_extract("path", r"filename=([^/]+)/", 1).alias("filename"), "job", "line")


@report("load_log_uploads")
def load_log_uploads(spark, sf_dir):
    from ..sources import files
    path = _doc_files(spark, sf_dir)
    out = files.load_uploads(spark, path)
    return out.select(F.regexp_extract("path", r"filename=([^/]+)/", 1).alias("filename"), "refused", "line")


def _analyses(spark, sf_dir):
    from ..sources import envelopes
    hdr = envelopes.alert_header(_envelopes(spark, sf_dir))
    return hdr.select(
        "org_id", F.coalesce("alertname", F.lit("alert")).alias("title"),
        F.when(F.coalesce("alertname", F.lit("")).rlike("ERROR|CRITICAL"), "critical").otherwise("warning")
        .alias("severity"),
        F.when(F.col("service").isNotNull(), F.array("service")).otherwise(F.array().cast("array<string>"))
        .alias("services"),
        F.coalesce("app", F.lit("Unknown")).alias("team"), "ts", F.col("env_id").alias("seq"),
        F.lit(None).cast("string").alias("duplicate_of"), F.lit(None).cast("string").alias("cascade_of"),
        F.lit(None).cast("struct<service:string,symptom:string>").alias("cascade_entry"))


def _incidents(spark, sf_dir):
    from ..operators import incidents
    empty = spark.createDataFrame([], incidents.INCIDENT_SCHEMA)
    return incidents.upsert_incidents(empty, _analyses(spark, sf_dir))


@report("incident_upsert")
def incident_upsert(spark, sf_dir):
    out = _incidents(spark, sf_dir)
    return out.select("inc_id", "org_id", "title", "severity", "occurrences", iso("first_seen").alias("first_seen"),
                      iso("last_seen").alias("last_seen"), "status")


# The driver replay's split into known incidents and a new batch.
DRIVER_INCIDENT_SPLIT = "2024-01-16 00:00:00"


def _incident_batch(spark, sf_dir):
    """Known incidents (two titles twice, some resolved) and a later batch that names duplicates and roots."""
    from ..operators import incidents
    a = _analyses(spark, sf_dir)
    split = F.lit(DRIVER_INCIDENT_SPLIT).cast("timestamp")
    old = incidents.upsert_incidents(spark.createDataFrame([], incidents.INCIDENT_SCHEMA),
                                     a.where(F.col("ts") < split)).checkpoint()
    twin = old.where(F.col("inc_id") <= "INC-0002").withColumn("inc_id", F.concat(F.lit("INC-00"), F.substring("inc_id", 5, 4)))
    base = incidents.resolve_incidents(old, old.where(F.col("inc_id") >= "INC-0004")).unionByName(twin)
    seq = F.col("seq")
    batch = a.where(F.col("ts") >= split).withColumns({
        "title": F.concat("title", F.when(seq % 5 == 0, F.concat(F.lit(" #"), (seq % 40).cast("string"))).otherwise(F.lit(""))),
        "duplicate_of": F.when(seq % 11 == 0, F.lit("INC-0002")).when(seq % 13 == 0, F.lit("INC-9999"))
        .when(seq % 17 == 0, F.lit("")),
        "cascade_of": F.when(seq % 7 == 0, F.lit("INC-0001")).when(seq % 9 == 0, F.lit("")),
        "cascade_entry": F.when(seq % 14 != 0, F.struct(
            F.when(seq % 4 != 0, F.try_element_at("services", F.lit(1))).alias("service"), F.lit("slow").alias("symptom")))})
    return base, batch


@report("incident_decisions")
def incident_decisions(spark, sf_dir):
    from ..operators import incidents
    decided, _ = incidents.decide(*_incident_batch(spark, sf_dir))
    return decided.select("seq", "org_id", "title", "action", "target")


@report("incident_next_state")
def incident_next_state(spark, sf_dir):
    from ..operators import incidents
    out = incidents.upsert_incidents(*_incident_batch(spark, sf_dir))
    return out.select("inc_id", "org_id", "title", "status", "occurrences", F.size("cascades").alias("n_cascades"),
                      iso("first_seen").alias("first_seen"), iso("last_seen").alias("last_seen"))


@report("incident_timeline")
def incident_timeline(spark, sf_dir):
    from ..operators import incidents
    decided, _ = incidents.decide(*_incident_batch(spark, sf_dir))
    return incidents.timeline_entries(decided).select("seq", "org_id", "inc_id", "pos", "time", "event", "color")


@report("open_incidents")
def open_incidents(spark, sf_dir):
    from ..operators import incidents
    out = incidents.open_incidents(_incidents(spark, sf_dir), 20)
    return out.select("org_id", "inc_id", "title", "severity")


@report("incidents_of_services")
def incidents_of_services(spark, sf_dir):
    from ..operators import incidents
    out = incidents.incidents_overlapping(_incidents(spark, sf_dir), "org-1", ["svc-1", "svc-3"])
    return out.select("inc_id", "title", "severity", F.array_join("services", ",").alias("services"),
                      iso("last_seen").alias("last_seen"))


@report("fetch_context_logs")
def fetch_context_logs(spark, sf_dir):
    from ..operators import context
    from ..sources import envelopes
    env = _envelopes(spark, sf_dir)
    hdr = envelopes.alert_header(env)
    traces = envelopes.alert_to_logs(env).where(F.col("pos") == 0).select("env_id", "trace_id")
    # a third of the requests name no service, half of those no trace either
    named = F.when(F.col("env_id") % 3 != 0, F.col("service"))
    req = hdr.join(traces, "env_id", "left").select(
        F.col("env_id").alias("req_id"), "org_id", F.col("ts").alias("as_of"), named.alias("service"),
        F.when(F.col("env_id") % 6 != 0, F.col("trace_id")).alias("trace_id"))
    checkpoint_dir(spark)
    req = req.checkpoint()  # one parse of the envelopes for all branches
    out = context.fetch_context_logs(req, views.log_lines_v(spark, sf_dir), limit=50)
    return out.select("req_id", "branch", "line_id")


# ---------------------------------------------------------------- poll ticks and stages

# Tick length of the driver replay (events span 30 days).
DRIVER_TICK_DAYS = 10


# Words whose presence is the replay's vector (SQL can compute it too), threshold, trend.
DRIVER_VECTOR_WORDS = ("error_rate", "p99_latency_ms", "active_connections", "log_error", "rss_mb", "severity=critical")
DRIVER_RECURRENCE = 0.86


def _word_vector(text):
    """Unit vector of the words a signature has; an injected embedder."""
    hits = F.array(*[F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(w)), 1.0).otherwise(0.0)
                     for w in DRIVER_VECTOR_WORDS])
    norm = F.sqrt(F.aggregate(hits, F.lit(0.0), lambda acc, x: acc + x))
    return F.transform(hits, lambda x: (x / F.greatest(norm, F.lit(1.0))).cast("float"))


@report("index_upkeep")
def index_upkeep(spark, sf_dir):
    """Index after three additions: two thirds of the cases, all with a fifth of the signatures replaced, a seventh gone."""
    from ..operators import embed
    checkpoint_dir(spark)
    c = views.cases_v(spark, sf_dir).select("id", "org_id", "primary_service", "signature_text").checkpoint()
    text = F.when(F.col("id") % 5 == 0, F.concat("signature_text", F.lit(" error_rate"))).otherwise(F.col("signature_text"))
    index = embed.index_changes(None, c.where("id % 3 <> 0"), 1, embedder=_word_vector).checkpoint()
    for version, cases in ((2, c.withColumn("signature_text", text)),
                           (3, c.withColumn("signature_text", text).where("id % 7 <> 0"))):
        index = index.unionByName(embed.index_changes(index, cases, version, whole=True, embedder=_word_vector)).checkpoint()
    parts = F.array_join(F.transform("vector", lambda x: F.round(x.cast("double"), 4).cast("decimal(6,4)").cast("string")), ",")
    return embed.live_index(index).select("case_id", "org_id", "service", "digest", parts.alias("vector"), "version")


def _tick_replay(spark, sf_dir, mode="pre_filter"):
    from ..streaming import jobs, ticks
    src = ticks.split_by_day(spark, sf_dir, jobs.run_folder(spark, "tick-input"), DRIVER_TICK_DAYS)
    state = jobs.run_folder(spark, "case-state")
    trend = ticks.Trend(lookback_seconds=6 * 3600.0, slope_mb_per_min=0.1, min_mb=150.0)
    cur = ticks.stream_recurrence(spark, src, "*.parquet", DRIVER_GAP_SECONDS, state, threshold=DRIVER_RECURRENCE,
                                  lookback_seconds=DRIVER_TICK_DAYS * 86400.0, mode=mode, embedder=_word_vector,
                                  trend=trend)
    return state, cur


def _case_rows(cur):
    return cur.select("id", "org_id", "primary_service", iso("opened_at").alias("opened_at"),
                      iso("updated_at").alias("updated_at"), "occurrence_count", "status", "severity",
                      F.round(F.col("similarity_score").cast("double"), 2).alias("score"))


@report("stream_recurrence")
def stream_recurrence(spark, sf_dir):
    return _case_rows(_tick_replay(spark, sf_dir)[1])


@report("recurrence_replay")
def recurrence_replay(spark, sf_dir):
    return _case_rows(_tick_replay(spark, sf_dir, mode="post_filter")[1])


@report("stream_stages")
def stream_stages(spark, sf_dir):
    from ..streaming import ticks
    state, _ = _tick_replay(spark, sf_dir)
    ticks.summarize_stage(spark, state, views.logs_v(spark, sf_dir))
    ticks.match_stage(spark, state)
    cur = ticks.current_cases(spark, state)
    al = ticks.current_alerts(spark, state).groupBy(F.col("case_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_alerts"), F.sum("duplicate_count").alias("n_breaches"))
    tl = ticks.current_timeline(spark, state).groupBy(F.col("case_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_entries"))
    return cur.join(al, "id", "left").join(tl, "id", "left").select(
        "id", "org_id", "primary_service", iso("opened_at").alias("opened_at"),
        F.col("summarized_at").isNotNull().alias("summarized"), F.col("matched_at").isNotNull().alias("matched"),
        "title", "n_alerts", "n_breaches", "n_entries")
