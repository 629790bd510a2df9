"""Alert-webhook envelopes: firing alerts, header pick, inline log lines.

A payload is either ``{"alerts": [...], "context": {"logs": [...]}}`` or a
single bare alert. Status defaults to ``firing``; only firing alerts count.
The header scan walks the firing alerts in order up to and including the
first one with a service label (``service_name`` else ``service``); the app
(``app`` else ``job``) is the last scanned alert's, the alert name the first
non-empty one seen. Empty strings count as missing. All of it is array
logic inside each row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse

ALERT = "struct<status:string,labels:map<string,string>,annotations:map<string,string>,startsAt:string>"
ENVELOPE = (f"struct<alerts:array<{ALERT}>,status:string,labels:map<string,string>,"
            "annotations:map<string,string>,startsAt:string,"
            "context:struct<logs:array<string>,traces:array<string>>>")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row however often it is used.

    It is generated (a list of one, exploded), so later filters and projections refer to the value and
    the optimizer does not copy its expression into each of them. A null value stays a row.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def parse_envelopes(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Adds ``env``, the payload parsed once; null where the payload is null."""
    return once(df, "env", F.from_json(F.col(payload_col), ENVELOPE))


def _alerts(env: Column) -> Column:
    self_alert = F.struct(env["status"].alias("status"), env["labels"].alias("labels"),
                          env["annotations"].alias("annotations"), env["startsAt"].alias("startsAt"))
    return F.coalesce(env["alerts"], F.array(self_alert))


def _firing(a: Column) -> Column:
    return F.coalesce(a["status"], F.lit("firing")) == "firing"


def _svc(a: Column) -> Column:
    return F.coalesce(parse.nonempty(a["labels"]["service_name"]), parse.nonempty(a["labels"]["service"]))


def _app(a: Column) -> Column:
    return F.coalesce(parse.nonempty(a["labels"]["app"]), parse.nonempty(a["labels"]["job"]))


def firing_alerts(envs: DataFrame, id_col: str = "env_id") -> DataFrame:
    """One row per firing alert with its position in the payload."""
    ex = envs.select(id_col, "ts", F.posexplode(_alerts(F.col("env"))).alias("pos", "a"))
    return ex.where(_firing(F.col("a"))).select(
        id_col, "ts", "pos", F.coalesce(F.col("a.status"), F.lit("firing")).alias("status"),
        F.col("a.labels")["alertname"].alias("alertname"), _svc(F.col("a")).alias("service"),
        _app(F.col("a")).alias("app"))


def alert_header(envs: DataFrame, id_col: str = "env_id") -> DataFrame:
    """service, app, alertname per payload with at least one firing alert."""
    keep = [c for c in (id_col, "ts", "org_id") if c in envs.columns]
    # the firing list is computed once per row and referenced by name below
    step = envs.select(*keep, F.coalesce(F.col("env.context.logs"), F.array().cast("array<string>")).alias("logs"),
                       F.filter(_alerts(F.col("env")), _firing).alias("_firing"))
    step = step.where(F.size("_firing") > 0)
    found = F.array_position(F.transform("_firing", lambda a: _svc(a).isNotNull()), True)
    upto = F.when(found > 0, found).otherwise(F.size("_firing"))
    scanned = step.select(*keep, "logs", F.slice("_firing", F.lit(1), upto).alias("_scanned"))
    last = F.try_element_at(F.col("_scanned"), F.lit(-1))
    names = F.filter(F.transform("_scanned", lambda a: parse.nonempty(a["labels"]["alertname"])),
                     lambda x: x.isNotNull())
    return scanned.select(*keep, _svc(last).alias("service"), _app(last).alias("app"),
                          F.try_element_at(names, F.lit(1)).alias("alertname"), "logs")


def alert_to_logs(envs: DataFrame, id_col: str = "env_id") -> DataFrame:
    """Inline log lines of firing payloads parsed into log rows; event = slug(alert name)."""
    from ..operators.logparse import parse_lines
    hdr = alert_header(envs, id_col)
    lines = hdr.select(id_col, "ts", *[c for c in ("org_id",) if c in hdr.columns],
                       parse.slug(F.col("alertname")).alias("event"),
                       F.posexplode("logs").alias("pos", "line"))
    return parse_lines(lines, "line")
