import datetime as dt
import random
from decimal import Decimal

from pulsegrid.operators import cases, cooldown, incidents, teams

T0 = dt.datetime(2026, 7, 22, 11, 0, 0)
CASES = ("id bigint, org_id string, status string, primary_service string, opened_at timestamp, "
         "updated_at timestamp, similarity_score decimal(5,4), occurrence_count int, severity string, "
         "summarized_at timestamp, matched_at timestamp")


def test_cooldown_chain(spark):
    at = [0, 30, 59, 60, 100, 120]
    items = spark.createDataFrame([("s", "a", int(s * 1e6), i) for i, s in enumerate(at)],
                                  "service string, alert string, us long, id long")
    fired = cooldown.fired_alerts(items, ["service", "alert"], 60)
    assert sorted(r["us"] // 1_000_000 for r in fired.collect()) == [0, 60, 120]


def _fired_one_by_one(rows, cooldown_us):
    last, out = {}, []
    for key, us, rid in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        if key not in last or us - last[key] >= cooldown_us:
            out.append((key, us, rid))
            last[key] = us
    return sorted(out, key=str)


def test_cooldown_equals_the_sequential_rule(spark):
    """Bursts, gaps, ties, one hot key, null keys and times, moments on both sides of 1970."""
    rng = random.Random(7)
    rows, rid = [], 0
    for key, n, span in (("hot", 1500, 40_000), ("sparse", 40, 2_000_000), ("burst", 200, 90), (None, 60, 5_000), ("one", 1, 1)):
        base = -span // 2 if key in ("hot", "sparse", None) else 10_000
        for _ in range(n):
            rid += 1
            rows.append((key, (base + rng.randrange(span)) * 1_000_000 + rng.choice((0, 0, 1, 999_999)), rid))
    rows += [(k, us, rid + i) for i, (k, us, _) in enumerate(rows[::9], 1)] + [("hot", None, 0)]
    items = spark.createDataFrame(rows, "k string, us long, id long").repartition(7)
    for seconds in (60, 61.5, 3600):
        got = cooldown.fired_alerts(items, ["k"], seconds).collect()
        assert sorted(((r["k"], r["us"], r["id"]) for r in got), key=str) == _fired_one_by_one(rows, int(seconds * 1e6))


def test_cooldown_levels_hold_no_more_steps_than_alerts(spark):
    """All functions together stay linear in the alerts, whatever the number of levels."""
    rows = [("k", s * 1_000_000, s) for s in range(0, 40_000, 7)]
    level = cooldown._stretch_functions(spark.createDataFrame(rows, "k string, us long, id long"), ["k"], 60_000_000)
    total = 0
    for _ in range(11):
        level = cooldown._compose(level, ["k"]).checkpoint()
        total += level.count()
    assert level.select("node").distinct().count() == 1 and total <= 2 * len(rows)


def test_cooldown_edges(spark):
    schema = "k string, us long, id long"
    assert cooldown.fired_alerts(spark.createDataFrame([], schema), ["k"], 60).collect() == []
    assert cooldown.fired_alerts(spark.createDataFrame([("a", None, 1)], schema), ["k"], 60).collect() == []
    none = cooldown.fired_alerts(spark.createDataFrame([("a", 5, 2), ("a", 5, 1), ("a", 6, 3)], schema), ["k"], 0)
    assert sorted((r["us"], r["id"]) for r in none.collect()) == [(5, 1), (6, 3)]


def test_recurrence_reopens_and_escalates(spark):
    c = spark.createDataFrame([
        (1, "o", "RESOLVED", "s", T0, T0, None, 1, "warning", T0, T0),
        (2, "o", "OPEN", "s", T0, T0, None, 1, "critical", T0, None)], CASES)
    m = spark.createDataFrame([(1, Decimal("0.9"), T0 + dt.timedelta(minutes=5), 1, "warning"),
                               (2, Decimal("0.95"), T0 + dt.timedelta(minutes=5), 2, "warning")],
                              "case_id long, score decimal(5,4), at timestamp, seq long, severity string")
    out = {r["id"]: r for r in cases.recur_cases(c, m).collect()}
    assert out[1]["status"] == "INVESTIGATING" and out[1]["summarized_at"] is None and out[1]["matched_at"] is None
    assert out[1]["occurrence_count"] == 2
    assert out[2]["severity"] == "critical" and out[2]["summarized_at"] == T0


def test_alert_rollup_keeps_first_severity(spark):
    schema = ("id bigint, case_id bigint, service string, metric string, severity string, triggered_at timestamp, "
              "source_tool string, duplicate_count int, received_at timestamp")
    batch = spark.createDataFrame([
        (1, 9, "s", "m", "warning", T0, "t", 1, T0),
        (2, 9, "s", "m", "critical", T0 + dt.timedelta(seconds=5), "t", 1, T0 + dt.timedelta(seconds=9))], schema)
    out = cases.alert_rollup(spark.createDataFrame([], schema), batch).collect()
    assert len(out) == 1 and out[0]["severity"] == "warning" and out[0]["duplicate_count"] == 2
    assert out[0]["received_at"] == T0 + dt.timedelta(seconds=9)


def test_member_without_team_services_sees_whole_org(spark):
    t = spark.createDataFrame([(1, "o", "empty", []), (2, "o", "pay", ["svc-a"])],
                              "id int, org_id string, name string, services array<string>")
    u = spark.createDataFrame([(10, "o", "u1", "member", 1), (11, "o", "u2", "member", 2),
                               (12, "o", "u3", "org_admin", 2)],
                              "id long, org_id string, name string, role string, team_id int")
    c = spark.createDataFrame([(i, "o", "OPEN", s, T0, T0, None, 1, "warning", None, None)
                               for i, s in enumerate(["svc-a", "svc-b", "svc-b"])], CASES)
    out = {r["user_id"]: r["n_visible"] for r in teams.visible_case_counts(u, t, c).collect()}
    assert out == {10: 3, 11: 1, 12: 3}


def test_incident_upsert_numbers_and_repeats(spark):
    a = spark.createDataFrame([
        ("o", "Boom", "critical", ["s"], "team", T0, 1, None, None, None),
        ("o", "Boom", "critical", ["s"], "team", T0 + dt.timedelta(minutes=1), 2, None, None, None),
        ("o", "Other", "warning", ["s"], "team", T0 + dt.timedelta(minutes=2), 3, None, None, None),
        ("o", "Ghost", "warning", ["s"], "team", T0 + dt.timedelta(minutes=3), 4, "INC-9999", None, None)],
        "org_id string, title string, severity string, services array<string>, team string, ts timestamp, "
        "seq long, duplicate_of string, cascade_of string, cascade_entry struct<service:string,symptom:string>")
    out = {r["title"]: r for r in incidents.upsert_incidents(
        spark.createDataFrame([], incidents.INCIDENT_SCHEMA), a).collect()}
    assert set(out) == {"Boom", "Other"}
    assert out["Boom"]["inc_id"] == "INC-0001" and out["Boom"]["occurrences"] == 2
    assert out["Other"]["inc_id"] == "INC-0002"


def test_twin_alerts_are_rolled_up_alike_in_any_order(spark):
    schema = ("id bigint, case_id bigint, service string, metric string, severity string, triggered_at timestamp, "
              "source_tool string, duplicate_count int, received_at timestamp, org_id string, raw_payload string")
    twins = [(7, 1, "s", "m", "warning", T0, "t", 1, T0, "o", f'{{"q":{q}}}') for q in (3, 1, 2)]
    empty = spark.createDataFrame([], schema)
    for rows in (twins, twins[::-1], twins[1:] + twins[:1]):
        out = cases.alert_rollup(empty, spark.createDataFrame(rows, schema).repartition(3)).collect()
        assert [(r["id"], r["raw_payload"], r["duplicate_count"]) for r in out] == [(7, '{"q":1}', 3)]
    first = [(*twins[0], 2), (*twins[1], 1), (*twins[2], 0)]  # a real sequence decides before the payload
    out = cases.alert_rollup(empty, spark.createDataFrame(first, schema + ", ingest_seq long")).collect()
    assert [r["raw_payload"] for r in out] == ['{"q":2}']


def test_case_view_has_all_lists(spark):
    """Stored lists and the timeline in order; absent, null and empty ones are empty."""
    from pulsegrid.operators import caseview
    schema = CASES + (", title string, ai_summary string, signature_text string, "
                      f"hypotheses array<{caseview.CASE_LISTS['hypotheses']}>, evidence array<{caseview.CASE_LISTS['evidence']}>")
    row = lambda i, hyp, ev: (i, "o", "OPEN", "svc", T0, T0, None, 1, None, None, None, "", None, "t", hyp, ev)
    c = spark.createDataFrame([row(1, [(1, "cause", 80)], [("log", "svc", "line")]), row(2, [], None)], schema)
    teams = spark.createDataFrame([(1, "o", "core", ["svc"])], "id long, org_id string, name string, services array<string>")
    at = lambda m: T0 + dt.timedelta(minutes=m)
    entries = spark.createDataFrame([(1, at(2), 0, "b", "two", "#2"), (1, at(1), 1, "a", "one'", "#1"), (1, at(1), 0, "a", "one", "#1")],
                                    "case_id long, at timestamp, seq long, time string, event string, color string")
    out = {r["id"]: r for r in caseview.case_view(caseview.with_timeline(c, entries), teams).collect()}
    assert [e["event"] for e in out[1]["timeline"]] == ["one", "one'", "two"] and out[1]["evidence"][0]["text"] == "line"
    assert out[1]["hypotheses"][0]["confidence"] == 80 and out[1]["team"] == "core" and out[1]["severity"] == "warning"
    assert all(out[2][k] == [] for k in ("timeline", "evidence", "hypotheses", "cascades")) and out[2]["latest_logs"] is None
    assert caseview.case_view(c.drop("evidence"), teams).where("id = 1").first()["evidence"] == []
