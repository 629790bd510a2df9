import datetime as dt
import random

from pulsegrid.operators import context, substring

T0 = dt.datetime(2026, 7, 22, 11, 0, 0)
NEEDLES = "req_id long, org_id string, as_of timestamp, needle string"
LINES = "line_id long, org_id string, ts timestamp, line string"


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_contains_join_equals_brute_force(spark):
    """Texts of all lengths, some in no line; a third of the lines in one bucket; letters outside Latin; repeats."""
    rng = random.Random(3)
    letters = "abcé日 ="
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    lines = [(i, rng.choice("op"), _at(rng.choice((5, rng.randrange(900)))), word(rng.randrange(30))) for i in range(500)]
    lines += [(900, "o", _at(10), None), (901, "o", _at(10), ""), (902, "o", _at(10), "x" * 5000 + "abcabc"), lines[0], lines[0]]
    cut = lambda t: t[rng.randrange(max(1, len(t) // 2)):][:rng.randrange(1, 12)]
    needles = [(i, rng.choice("op"), _at(rng.randrange(1000)), cut(rng.choice(lines[:500])[3])) for i in range(150)]
    needles += [(200, "o", _at(20), ""), (201, "o", _at(20), None), (202, "o", _at(20), "abcabc"), (203, "o", _at(20), "nowhere"),
                needles[1], needles[1]]
    got = substring.contains_join(
        spark.createDataFrame(needles, NEEDLES).repartition(3), spark.createDataFrame(lines, LINES).repartition(5), ["org_id"],
        substring.F.col("as_of") - substring.F.expr("INTERVAL 200 SECONDS"), substring.F.col("as_of"), bucket_seconds=60)
    want = [(n[0], ln[0]) for n in needles for ln in lines if n[3] is not None and ln[3] is not None and n[1] == ln[1]
            and n[2] - dt.timedelta(seconds=200) <= ln[2] <= n[2] and n[3] in ln[3]]
    assert sorted((r["req_id"], r["line_id"]) for r in got.collect()) == sorted(want) and len(want) > 300


def test_contains_join_of_empty_tables(spark):
    lines, needles = spark.createDataFrame([(1, "o", T0, "abcdef")], LINES), spark.createDataFrame([(1, "o", T0, "abcde")], NEEDLES)
    at = substring.F.col("as_of")
    assert substring.contains_join(needles.limit(0), lines, ["org_id"], at, at).collect() == []
    assert substring.contains_join(needles, lines.limit(0), ["org_id"], at, at).collect() == []
    assert len(substring.contains_join(needles, lines, ["org_id"], at, at).collect()) == 1


def test_context_fetch_finds_ids_and_services_anywhere(spark):
    lines = spark.createDataFrame([
        (1, "o", _at(0), "x [api] INFO go (trace_id=abcd1234)"), (2, "o", _at(1), "payload={trace_id=abcd1234-suffix}"),
        (3, "p", _at(1), "trace_id=abcd1234"), (4, "o", _at(2), "[web] ERROR call to billing-api failed"),
        (5, "o", _at(3), "[billing-api] INFO fine"), (6, "o", _at(4), "[db] WARN slow"), (7, "o", _at(5), "other_id=abcd1234")], LINES)
    req = spark.createDataFrame([
        (1, "o", _at(10), "billing-api", "abcd1234"), (2, "o", _at(10), "billing-api", "zzzz"), (3, "o", _at(10), "", ""),
        (4, "o", _at(10), "billing", None), (5, "o", _at(400), None, "abcd1234")],
        "req_id long, org_id string, as_of timestamp, service string, trace_id string")
    got = sorted((r["req_id"], r["branch"], r["line_id"]) for r in context.fetch_context_logs(req, lines).collect())
    assert got == [(1, "trace", 1), (1, "trace", 2), (2, "service", 4), (3, "level", 4), (3, "level", 6), (4, "service", 4)]
    last = context.fetch_context_logs(req.where("req_id = 1"), lines, limit=1).collect()
    assert [r["line_id"] for r in last] == [2]
