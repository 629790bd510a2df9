"""Legacy incidents: upsert of analysis results and the open-incident reads.

For a batch of analyses (org, title, severity, services, team, ts, and
optional duplicate_of / cascade_of / cascade_entry), processed in (ts, seq)
order the way single requests would be (an empty string counts as not given):

1. duplicate: a given ``duplicate_of`` id of the org, else one OPEN incident of
   the org with the same title, gets occurrences + 1 and last_seen; a given
   id that does not exist is ignored;
2. cascade: if a root id and an entry are given and the root exists, the entry
   {service, symptom, detected_at} is appended to the root;
3. new: id ``INC-%04d`` of (incident count + 1), status open.

Set-based: titles are grouped per org; the first analysis of a new title
creates the incident and later ones of the title are its repeats. Ids come
from a global sequence built from per-day counts and offsets, so numbering
needs no single-partition sort. Analyses may name incidents that the same
batch created before them: the created incidents are computed again with
those of the pass before until they stay the same (one pass if no analysis
names an id unknown before the batch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def global_sequence(df: DataFrame, order_cols, bucket: Column, start: int | Column = 1,
                    out_col: str = "seq") -> DataFrame:
    """1-based global order over ``order_cols`` (``bucket`` must be monotone in them)."""
    b = df.withColumn("_sb", bucket)
    counts = b.groupBy("_sb").agg(F.count(F.lit(1)).alias("_sn"))
    offsets = counts.withColumn(
        "_soff", F.coalesce(F.sum("_sn").over(Window.orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)),
                            F.lit(0)))
    w = Window.partitionBy("_sb").orderBy(*order_cols)
    start_c = start if isinstance(start, Column) else F.lit(start)
    return (b.join(offsets.select("_sb", "_soff"), "_sb")
            .withColumn(out_col, F.col("_soff") + F.row_number().over(w) + start_c - 1)
            .drop("_sb", "_soff"))


INCIDENT_SCHEMA = ("inc_id string, title string, severity string, status string, services array<string>, "
                   "team string, occurrences int, "
                   "cascades array<struct<service:string,symptom:string,detected_at:string>>, "
                   "first_seen timestamp, last_seen timestamp, org_id string")
CASCADE_T = "array<struct<service:string,symptom:string,detected_at:string>>"


def _given(col: str) -> Column:
    return F.nullif(F.col(col), F.lit(""))


def _order() -> Column:
    return F.struct("ts", "seq")


def _created(analyses: DataFrame, known: DataFrame, base: int) -> DataFrame:
    """org_id, title, made_id, made_at, and the first analysis of each new incident; ``known``: org_id, _kid, _kat."""
    root = known.select("org_id", F.col("_kid").alias("_root"), F.col("_kat").alias("_rat"))
    a = analyses.join(root, ["org_id", "_root"], "left")
    exists = F.col("_rat").isNotNull() & (F.col("_rat") < _order()) & F.col("cascade_entry").isNotNull()
    fresh = (a.where(F.col("_given_dup").isNull() & F.col("_open_id").isNull() & ~exists)
             .groupBy("org_id", "title")
             .agg(F.min_by(F.struct("severity", "services", "team", "ts", "seq"), _order()).alias("_f")))
    numbered = global_sequence(fresh, [F.col("_f.ts"), F.col("_f.seq"), F.col("org_id"), F.col("title")],
                               F.to_date(F.col("_f.ts")), start=base + 1)
    return numbered.select("org_id", "title", F.format_string("INC-%04d", F.col("seq")).alias("made_id"),
                           F.struct("_f.ts", "_f.seq").alias("made_at"), "_f")


def decide(incidents: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The analyses with ``action`` (updated, ignored, cascade, created) and ``target`` id; the created incidents."""
    checkpoint_dir(incidents.sparkSession)
    incidents, analyses = incidents.checkpoint(), analyses.checkpoint()  # both are read several times
    base = incidents.count()  # a scalar: the next id starts after the existing incidents
    ids = incidents.select("org_id", F.col("inc_id").alias("_kid"),
                           F.struct(F.lit("0001-01-01").cast("timestamp").alias("ts"),
                                    F.lit(-1).cast("bigint").alias("seq")).alias("_kat"))
    open_titles = (incidents.where(F.col("status") == "open").groupBy("org_id", "title")
                   .agg(F.min("inc_id").alias("_open_id")))
    a = (analyses.withColumns({"_given_dup": _given("duplicate_of"), "_root": _given("cascade_of"),
                               "seq": F.col("seq").cast("bigint")})
         .join(open_titles, ["org_id", "title"], "left"))
    made = _created(a, ids, base).checkpoint()
    named = a.where(F.col("_root").isNotNull() & F.col("cascade_entry").isNotNull()).select(
        "org_id", F.col("_root").alias("_kid"))
    if not named.join(ids, ["org_id", "_kid"], "left_anti").isEmpty():
        while True:
            again = _created(a, ids.unionByName(made.select("org_id", F.col("made_id").alias("_kid"),
                                                            F.col("made_at").alias("_kat"))), base).checkpoint()
            seen = ["org_id", "title", "made_id", "made_at"]
            if again.select(*seen).exceptAll(made.select(*seen)).isEmpty() and \
                    made.select(*seen).exceptAll(again.select(*seen)).isEmpty():
                break
            made = again
    known = ids.unionByName(made.select("org_id", F.col("made_id").alias("_kid"), F.col("made_at").alias("_kat")))
    a = a.join(made.select("org_id", "title", "made_id", "made_at"), ["org_id", "title"], "left")
    for name, ref in (("_dup_at", "_given_dup"), ("_root_at", "_root")):
        a = a.join(known.select("org_id", F.col("_kid").alias(ref), F.col("_kat").alias(name)), ["org_id", ref], "left")
    repeat = F.coalesce("_open_id", F.when(F.col("made_at") < _order(), F.col("made_id")))
    action = (F.when(F.col("_given_dup").isNotNull(),
                     F.when(F.col("_dup_at") < _order(), F.lit("updated")).otherwise(F.lit("ignored")))
              .when(repeat.isNotNull(), F.lit("updated"))
              .when((F.col("_root_at") < _order()) & F.col("cascade_entry").isNotNull(), F.lit("cascade"))
              .otherwise(F.lit("created")))
    a = a.withColumn("action", action).withColumn(
        "target", F.when(F.col("action") == "ignored", F.lit(None)).when(F.col("action") == "cascade", F.col("_root"))
        .when(F.col("action") == "created", F.col("made_id")).otherwise(F.coalesce("_given_dup", repeat)))
    return a.drop("_given_dup", "_root", "_open_id", "made_id", "made_at", "_dup_at", "_root_at").checkpoint(), made


def upsert_incidents(incidents: DataFrame, analyses: DataFrame) -> DataFrame:
    """Next incident state after a batch of analyses.

    ``analyses``: org_id, title, severity, services, team, ts, seq, duplicate_of,
    cascade_of, cascade_entry (struct<service,symptom>); the last three may be NULL.
    """
    a, made = decide(incidents, analyses)
    fresh = made.select(
        F.col("made_id").alias("inc_id"), "title", F.col("_f.severity").alias("severity"), F.lit("open").alias("status"),
        F.col("_f.services").alias("services"), F.coalesce("_f.team", F.lit("Unknown")).alias("team"),
        F.lit(1).alias("occurrences"), F.array().cast(CASCADE_T).alias("cascades"),
        F.col("_f.ts").alias("first_seen"), F.col("_f.ts").alias("last_seen"), "org_id")
    updates = (a.where(F.col("action") == "updated").groupBy("org_id", F.col("target").alias("inc_id"))
               .agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last")))
    entry = F.struct(F.coalesce(F.col("cascade_entry.service"), F.lit("unknown")).alias("service"),
                     F.coalesce(F.col("cascade_entry.symptom"), F.lit("")).alias("symptom"),
                     F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("detected_at"))
    casc = (a.where(F.col("action") == "cascade").groupBy("org_id", F.col("target").alias("inc_id"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ts").alias("t"), F.col("seq").alias("s"),
                                                                  entry.alias("e")))), lambda x: x["e"])
                 .alias("_c"), F.max("ts").alias("_clast")))
    cur = incidents.unionByName(fresh).join(updates, ["org_id", "inc_id"], "left").join(casc, ["org_id", "inc_id"], "left")
    return cur.select(
        "inc_id", "title", "severity", "status", "services", "team",
        (F.col("occurrences") + F.coalesce("_n", F.lit(0))).cast("int").alias("occurrences"),
        F.concat(F.coalesce("cascades", F.array().cast(CASCADE_T)), F.coalesce("_c", F.array().cast(CASCADE_T)))
        .alias("cascades"),
        "first_seen", F.greatest("last_seen", "_last", "_clast").alias("last_seen"), "org_id")


#: Texts and colours of incident timeline entries.
CREATED_ENTRIES = (("Logs analyzed by AI agent", "#818cf8"), ("Root cause hypotheses generated", "#a78bfa"),
                   ("Supporting evidence collected", "#34d399"))


def timeline_entries(decided: DataFrame) -> DataFrame:
    """Timeline rows of a batch's decisions: org_id, inc_id, ts, seq, pos, time, event, color."""
    def entries(*pairs):
        return F.array(*[F.struct(F.lit(e).alias("event") if isinstance(e, str) else e.alias("event"),
                                  F.lit(c).alias("color")) for e, c in pairs])

    service, symptom = F.col("cascade_entry.service"), F.col("cascade_entry.symptom")
    what = (F.when(F.col("action") == "updated", entries(("Occurred again", "#fbbf24")))
            .when(F.col("action") == "cascade", entries((F.concat(
                F.lit("Cascade: "), F.coalesce(service, F.lit("?")), F.lit(" — "), F.coalesce(symptom, F.lit(""))), "#fb923c")))
            .when(F.col("action") == "created", entries(*CREATED_ENTRIES, (F.concat(
                F.lit("Routed to "), F.coalesce("team", F.lit("?"))), "#60a5fa"))))
    return decided.select("org_id", F.col("target").alias("inc_id"), "ts", "seq", F.posexplode(what).alias("pos", "e")) \
        .select("org_id", "inc_id", "ts", "seq", "pos", F.date_format("ts", "HH:mm:ss").alias("time"), "e.event", "e.color")


def resolve_incidents(incidents: DataFrame, commands: DataFrame) -> DataFrame:
    """Status resolved for the (org_id, inc_id) of the commands; others stay."""
    hit = commands.select("org_id", "inc_id").distinct().withColumn("_hit", F.lit(True))
    return incidents.join(hit, ["org_id", "inc_id"], "left").withColumn(
        "status", F.when(F.col("_hit"), F.lit("resolved")).otherwise(F.col("status"))).drop("_hit")


def open_incidents(incidents: DataFrame, limit: int = 20) -> DataFrame:
    """Per org: open incidents, newest last_seen first, at most ``limit``."""
    w = Window.partitionBy("org_id").orderBy(F.col("last_seen").desc_nulls_first(), F.col("inc_id").desc())
    return (incidents.where(F.col("status") == "open").withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= limit).drop("_rn"))


def incidents_overlapping(incidents: DataFrame, org_id: str, services=None) -> DataFrame:
    """All incidents of an org, optionally those sharing a service with ``services``, newest first."""
    df = incidents.where(F.col("org_id") == org_id)
    if services:
        df = df.where(F.arrays_overlap("services", F.array(*[F.lit(x) for x in services])))
    return df.orderBy(F.col("last_seen").desc_nulls_first(), F.col("inc_id").desc())
