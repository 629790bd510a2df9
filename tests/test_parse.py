from pyspark.sql import functions as F

from pulsegrid.functions import parse
from pulsegrid.operators import logparse

LINES = [
    (1, "2026-07-22 11:22:02 CRITICAL [payment-service] Gateway unreachable | endpoint=stripe.api | retry=1/3 "
        "| trace_id=ab12"),
    (2, "2026-07-22 11:22:02 ERROR    [cart-service] order-service timeout | downstream_degraded | trace_id=ab12"),
    (3, "2026-07-22 11:22:02 INFO     [product-service] GET /x | q=a=b | q=c"),
    (4, "2026-07-22 11:22:02 WARN [s] msg"),
    (5, "no brackets here"),
]


def test_parse_lines(spark):
    df = spark.createDataFrame(LINES, "line_id long, line string")
    out = {r["line_id"]: r for r in logparse.parse_lines(df).collect()}
    assert set(out) == {1, 2, 3, 4}
    assert out[1]["level"] == "CRITICAL" and out[1]["message"] == "Gateway unreachable"
    assert out[1]["trace_id"] == "ab12" and len(out[1]["context"]) == 3
    assert out[2]["context"] == {"trace_id": "ab12"} and out[2]["service"] == "cart-service"
    assert out[3]["context"] == {"q": "c"}
    assert out[4]["context"] is None and out[4]["trace_id"] is None


def test_slug_and_case_ids(spark):
    df = spark.createDataFrame([("Cascade Failure",), ("Auth / JWT Failures",), ("!!!",), (None,)], "t string")
    assert [r[0] for r in df.select(parse.slug("t")).collect()] == [
        "cascade_failure", "auth_jwt_failures", "alert", "alert"]
    ids = spark.createDataFrame([("CASE-0007",), ("7",), ("CASE-x",)], "t string")
    assert [r[0] for r in ids.select(parse.parse_case_id("t")).collect()] == [7, 7, None]
    assert ids.select(parse.case_label(F.lit(7))).first()[0] == "CASE-0007"


def test_payloads_are_parsed_once(spark):
    """One ``from_json`` in the plans over envelopes; broken and null payloads stay rows without alerts."""
    from pulsegrid.operators import catalog
    from pulsegrid.sources import envelopes
    rows = [(1, '{"alerts":[{"labels":{"alertname":"Slow","service":"a","app":"x"}}],"context":{"logs":["l1","l2"]}}'),
            (2, '{"status":"resolved","labels":{"service":"b"}}'), (3, "{broken"), (4, None), (5, '{"labels":{"service":"c"}}')]
    raw = spark.createDataFrame([(i, p, 7) for i, p in rows], "env_id long, payload string, ts long").repartition(2)
    env = envelopes.parse_envelopes(raw)
    assert env.count() == 5
    hdr = {r["env_id"]: r["service"] for r in envelopes.alert_header(env).collect()}
    assert hdr[1] == "a" and hdr[5] == "c" and 2 not in hdr
    for out in (envelopes.alert_to_logs(env), envelopes.alert_header(env), catalog.service_catalog(envelopes.alert_header(env))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1
