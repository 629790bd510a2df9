"""Case state survives retry and restart, and an older summary does not undo a newer reopening."""

import datetime as dt
import json

import pytest

from pulsegrid.plans.reports import _word_vector
from pulsegrid.streaming import jobs, ticks

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
DAY = dt.datetime(2024, 1, 1)


def events(spark, day: int):
    rows = [(day * 1000 + i, DAY + dt.timedelta(days=day, minutes=i % 7), 3 + i % 2, "error", 100.0,
             json.dumps({"k": 1})) for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA)


def state_rows(spark, state):
    return sorted(tuple(r) for r in ticks.current_cases(spark, state).select(
        "id", "org_id", "status", "primary_service", "occurrence_count", "epoch", "updated_at", "title").collect())


def run(spark, state, day, batch):
    ticks.tick(spark, events(spark, day), state, batch, 1800.0, threshold=0.8, lookback_seconds=20 * 86400.0,
               embedder=_word_vector)


def test_retry_reopening_and_stage_order(spark):
    state = jobs.run_folder(spark, "t-state")
    run(spark, state, 0, 0)
    opened = state_rows(spark, state)
    assert opened and all(r[2] == "OPEN" and r[4] == 1 for r in opened)
    run(spark, state, 0, 0)  # the same batch again
    assert state_rows(spark, state) == opened
    run(spark, state, 1, 1)
    second = state_rows(spark, state)
    assert [r[0] for r in second] == [r[0] for r in opened] and all(r[4] == 2 for r in second)
    run(spark, state, 1, 1)
    assert state_rows(spark, state) == second

    ids = [r[0] for r in opened]
    summary = spark.createDataFrame([(i, 0, "old", "text", [], [], DAY) for i in ids], ticks.LOGS["summaries"])
    ticks._write(summary, state, "summaries", 0)
    assert all(r[7] == "old" for r in state_rows(spark, state))
    ticks.resolve(spark, state, ids, 0, DAY + dt.timedelta(days=1, hours=1))
    assert all(r[2] == "RESOLVED" for r in state_rows(spark, state))
    run(spark, state, 2, 2)
    reopened = state_rows(spark, state)
    # reopened in the next epoch: the summary of the old one no longer counts
    assert all(r[2] == "INVESTIGATING" and r[5] == 1 and r[7] is None and r[4] == 3 for r in reopened)
    ticks._write(summary.withColumn("title", ticks.F.lit("late")), state, "summaries", 7)
    assert state_rows(spark, state) == reopened

    alerts = ticks.current_alerts(spark, state).collect()
    assert {a["case_id"] for a in alerts} == set(ids) and all(a["org_id"] and "service" in a["raw_payload"] for a in alerts)
    events_of = [r["event"].split(" ")[0] for r in ticks.current_timeline(spark, state).orderBy("at", "seq").collect()]
    assert events_of.count("Case") == 2 * len(ids)  # opened, resolved
    assert events_of.count("Recurred") == 2 * len(ids)


def test_only_a_missing_log_is_empty(spark):
    state = jobs.run_folder(spark, "t-broken")
    assert ticks.read_log(spark, state, "cases").count() == 0
    spark.createDataFrame([("no parquet",)], "v string").write.text(f"{state}/cases/batch=0")
    with pytest.raises(Exception):
        ticks.read_log(spark, state, "cases").collect()


def test_initial_checkpoint(spark):
    pick = lambda *a: spark.range(1).select(ticks.initial_checkpoint(*a).cast("string")).first()[0]
    assert pick("2024-01-03", "2024-01-02", "2024-01-01").startswith("2024-01-03")
    assert pick(None, "2024-01-02", "2024-01-01").startswith("2024-01-02")
    assert pick(None, None, "2024-01-01").startswith("2024-01-01")


def test_each_prompt_is_sent_once_a_round(spark, tmp_path):
    """A model that varies and fails: one call per case and round, whatever sinks and retries follow."""
    calls = str(tmp_path / "calls")

    def client(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for i, p in zip(pdf["case_id"], pdf["prompt"]):
                strict = "IMPORTANT: Keep" in p
                with open(calls, "a") as f:  # one process group on one machine here
                    f.write(f"{i} {int(strict)}\n")
                n = sum(1 for _ in open(calls))
                whole = json.dumps({"title": f"call {n}", "hypotheses": [], "evidence": [], "ai_summary": "s"})
                out.append(whole if strict or i % 2 else "{broken")
            yield pd.DataFrame({"case_id": pdf["case_id"], "response": out})

    state = jobs.run_folder(spark, "t-model")
    run(spark, state, 0, 0)
    logs = spark.createDataFrame([], "id long, org_id string, service string, ts timestamp, level string, event string, "
                                     "message string, trace_id string")
    ticks.summarize_stage(spark, state, logs, client)
    asked = sorted(tuple(map(int, x.split())) for x in open(calls))
    ids = [r[0] for r in state_rows(spark, state)]
    assert asked == sorted([(i, 0) for i in ids] + [(i, 1) for i in ids if i % 2 == 0])
    summaries = {r["id"]: r["title"] for r in ticks.read_log(spark, state, "summaries").collect()}
    assert set(summaries) == set(ids) and all(t.startswith("call ") for t in summaries.values())
    entries = [r["case_id"] for r in ticks.current_timeline(spark, state).where("event = 'AI summary generated'").collect()]
    assert sorted(entries) == sorted(ids)  # no entry without its summary
    assert ticks.read_log(spark, state, "rejects").count() == 0

    store = ticks._once(spark, state, 0)
    store(spark.createDataFrame([(1, "never written")], ticks.context.ANSWERS), "answers_first")
    assert ticks.read_log(spark, state, "answers_first").where("response = 'never written'").count() == 0


def test_resolution_writes_its_timeline_entry(spark):
    state = jobs.run_folder(spark, "t-resolve")
    run(spark, state, 0, 0)
    ids = [r[0] for r in state_rows(spark, state)]
    ticks.resolve(spark, state, ids[:1], 0, DAY + dt.timedelta(hours=1))
    rows = ticks.current_timeline(spark, state).where("event = 'Case resolved'").collect()
    assert [(r["case_id"], r["time"]) for r in rows] == [(ids[0], "01:00:00")]


def test_a_retry_after_a_resolution_finds_what_the_first_attempt_found(spark):
    state = jobs.run_folder(spark, "t-pins")
    run(spark, state, 0, 0)
    run(spark, state, 1, 1)
    ids = [r[0] for r in state_rows(spark, state)]
    written = sorted(tuple(r) for r in ticks.read_log(spark, state, "cases").select("id", "status", "epoch", "batch").collect())
    ticks.resolve(spark, state, ids, 0, DAY + dt.timedelta(days=1, hours=1))
    run(spark, state, 1, 1)  # the same tick again, after the cases were resolved
    again = sorted(tuple(r) for r in ticks.read_log(spark, state, "cases").select("id", "status", "epoch", "batch").collect())
    assert again == written and {r[2] for r in again} == {0}
    run(spark, state, 2, 2)  # the next tick sees the resolution
    assert all(r[2] == "INVESTIGATING" and r[5] == 1 for r in state_rows(spark, state))


def _case_rows(spark, batch, ids):
    rows = [(i, "o", "OPEN", "s", DAY, DAY + dt.timedelta(hours=batch), "text", None, batch + 1, "warning", [0.5] * 16, 0) for i in ids]
    return spark.createDataFrame(rows, ticks.LOGS["cases"]).coalesce(1)


def _alert_rows(spark, batch, ids):
    rows = [("o", i, "s", "m", f"sev{batch}", DAY + dt.timedelta(hours=batch), "{}", "t", batch + 1, DAY + dt.timedelta(hours=batch))
            for i in ids]
    return spark.createDataFrame(rows, ticks.LOGS["alerts"]).coalesce(1)


def _bytes_of(df):
    from urllib.parse import unquote, urlparse
    import os
    return sum(os.path.getsize(unquote(urlparse(f).path)) for f in df.inputFiles())


def test_bytes_of_the_state_stay_flat_over_fifty_batches(spark):
    """The same cases recur for ever: a read opens one snapshot and the batches behind it, and equals the fold of all."""
    state = jobs.run_folder(spark, "t-snap")
    read = []
    for b in range(50):
        ticks._write(_case_rows(spark, b, range(b % 3, 30, 2)), state, "cases", b)
        ticks._write(_alert_rows(spark, b, range(b % 5, 30, 3)), state, "alerts", b)
        for name in ("cases", "alerts"):
            ticks.compact(spark, state, name, b)
        read.append(_bytes_of(ticks.read_state(spark, state, "cases")) + _bytes_of(ticks.read_state(spark, state, "alerts")))
        if b in (30, 49):
            for name in ("cases", "alerts"):
                for before in (None, b - 2):
                    whole = ticks.STATE_LOGS[name](ticks.read_log(spark, state, name, before))
                    seen = ticks.read_state(spark, state, name, before).select(*whole.columns)
                    assert sorted(map(str, seen.collect())) == sorted(map(str, whole.collect()))
    assert max(read[40:]) <= 1.2 * max(read[9:25]) < 0.5 * _bytes_of(ticks.read_log(spark, state, "cases").unionByName(
        ticks.read_log(spark, state, "alerts"), allowMissingColumns=True))
    assert len(ticks._snapshots(spark, state, "cases")) == 2
    with pytest.raises(ValueError):
        ticks._write(_case_rows(spark, 3, [1]), state, "cases", 3)


def test_a_snapshot_without_its_marker_does_not_count(spark):
    import os
    from urllib.parse import urlparse
    state = jobs.run_folder(spark, "t-half")
    for b in range(ticks.COMPACT_EVERY + 1):
        ticks._write(_case_rows(spark, b, [b % 4]), state, "cases", b)
    ticks.compact(spark, state, "cases", ticks.COMPACT_EVERY)
    newest = ticks._snapshots(spark, state, "cases")[-1]
    want = sorted(map(str, ticks.read_state(spark, state, "cases").collect()))
    os.remove(f"{urlparse(state).path}/_snapshots/cases/upto={newest}/_SUCCESS")
    assert ticks._snapshots(spark, state, "cases") == []
    assert sorted(map(str, ticks.read_state(spark, state, "cases").collect())) == want


def test_ticks_with_snapshots_equal_ticks_without(spark, monkeypatch):
    """Resolutions, reopenings and a retry over snapshots of two batches each."""
    def history(every):
        monkeypatch.setattr(ticks, "COMPACT_EVERY", every)
        state = jobs.run_folder(spark, "t-hist")
        for b in range(4):
            run(spark, state, b, b)
            if b in (1, 2):
                ids = [r[0] for r in state_rows(spark, state)]
                ticks.resolve(spark, state, ids[b % 2:], b, DAY + dt.timedelta(days=b, hours=1))
        run(spark, state, 3, 3)
        alerts = sorted(map(str, ticks.current_alerts(spark, state).drop("id", "case_id").collect()))
        return state, state_rows(spark, state), alerts

    plain, rows, alerts = history(1000)
    merged, rows2, alerts2 = history(2)
    assert ticks._snapshots(spark, plain, "cases") == [] and ticks._snapshots(spark, merged, "cases")
    assert rows2 == rows and alerts2 == alerts and max(r[5] for r in rows) > 0
