"""Case read model: the API shape of a case row, list and detail reads.

Python truthiness of the source (``x or default``) is kept: empty strings and
empty arrays fall back to the default just like NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from . import teams as teams_op

DEFAULT_SEVERITY = "warning"


def _or_empty_array(c: Column, elem: str) -> Column:
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, c).otherwise(F.array().cast(f"array<{elem}>"))


# Lists of a case and what they hold; a case table may lack them.
CASE_LISTS = {"hypotheses": "struct<rank:int,text:string,confidence:int>", "evidence": "struct<type:string,label:string,text:string>",
              "timeline": "struct<time:string,event:string,color:string>"}
CASCADE = "struct<service:string,symptom:string,detected_at:string>"


def with_timeline(cases: DataFrame, entries: DataFrame) -> DataFrame:
    """cases with ``timeline``, the entries (case_id, at, seq, time, event, color) in order of (at, seq).

    Entries are a few per case: openings, recurrences, summaries, matches and actions.
    """
    lists = entries.groupBy(F.col("case_id").alias("id")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "seq", "time", "event", "color"))),
        lambda e: F.struct(e["time"].alias("time"), e["event"].alias("event"), e["color"].alias("color"))).alias("timeline"))
    return cases.drop("timeline").join(lists, "id", "left")


def case_view(cases: DataFrame, teams: DataFrame) -> DataFrame:
    """API shape of cases. Lists that are null, empty or absent are empty; cascades and latest logs are never kept."""
    routed = teams_op.route(cases, teams)
    lists = {c: _or_empty_array(F.col(c) if c in cases.columns else F.lit(None).cast(f"array<{t}>"), t).alias(c)
             for c, t in CASE_LISTS.items()}
    return routed.select(
        "id", "org_id",
        parse.case_label("id").alias("inc_id"),
        F.coalesce(parse.nonempty(F.col("title")),
                   F.concat(F.col("primary_service"), F.lit(" — investigating"))).alias("title"),
        F.coalesce(parse.nonempty(F.col("severity")), F.lit(DEFAULT_SEVERITY)).alias("severity"),
        F.when(F.col("status") == "RESOLVED", "resolved").otherwise("open").alias("status"),
        F.when(parse.nonempty(F.col("primary_service")).isNotNull(), F.array(F.col("primary_service")))
        .otherwise(F.array().cast("array<string>")).alias("services"),
        "team",
        *lists.values(),
        F.coalesce(F.col("ai_summary"), F.lit("")).alias("ai_summary"),
        F.col("occurrence_count").alias("occurrences"),
        F.array().cast(f"array<{CASCADE}>").alias("cascades"),
        F.lit(None).cast("string").alias("latest_logs"),
        parse.py_isoformat("opened_at").alias("first_seen"),
        parse.py_isoformat("updated_at").alias("last_seen"),
        "updated_at",
    )


def case_list(cases: DataFrame, teams: DataFrame, org_id: str, services=None) -> DataFrame:
    c = cases.where(F.col("org_id") == org_id)
    if services:
        c = c.where(F.col("primary_service").isin(list(services)))
    return case_view(c, teams).orderBy(F.col("updated_at").desc_nulls_first(), F.col("id").desc())


def ranked_case_actions(case_actions: DataFrame, actions: DataFrame) -> DataFrame:
    """case_actions joined with the catalog, best score first (NULL scores last)."""
    a = actions.select(F.col("id").alias("action_id"), "name", "action_type", "description")
    j = case_actions.join(a, "action_id", "inner")
    return j.orderBy(F.col("case_id"), F.col("similarity_score").desc_nulls_last(), F.col("action_id"))


# Columns of a suggested action that an application fills; what they are until then.
APPLIED_STATE = {"status": ("string", "suggested"), "applied_by": ("string", None), "applied_at": ("timestamp", None),
                 "result": ("string", None)}


def case_detail(requests: DataFrame, cases: DataFrame, teams: DataFrame, case_actions: DataFrame,
                actions: DataFrame, ref_col: str = "ref") -> DataFrame:
    """Batch of ``GET case`` requests (ref, org_id): found cases with their ranked actions nested.

    A nested action has its name, type and description, its score and its state: status, applied_by,
    applied_at and result of ``cases.apply_to_case_actions``, or ``suggested`` where ``case_actions`` lack
    them. Best score first, null scores last, ties by action id. A case of another org is not found,
    exactly like a missing one.
    """
    req = requests.withColumn("case_id", parse.parse_case_id(F.col(ref_col))).where(F.col("case_id").isNotNull())
    wanted = req.select("case_id", "org_id").distinct()
    view = case_view(cases.join(wanted.withColumnRenamed("case_id", "id"), ["id", "org_id"], "left_semi"), teams)
    state = case_actions.withColumns({c: F.lit(first).cast(t) for c, (t, first) in APPLIED_STATE.items()
                                      if c not in case_actions.columns})
    named = state.join(wanted.select("case_id").distinct(), "case_id", "left_semi").join(
        actions.select(F.col("id").alias("action_id"), "name", "action_type", "description"), "action_id")
    order = (-F.coalesce(F.col("similarity_score").cast("double"), F.lit(float("-inf")))).alias("neg_score")
    acts = named.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(
        order, "action_id", "name", "action_type", "description", "similarity_score", *APPLIED_STATE))).alias("actions"))
    found = req.join(view.withColumnRenamed("id", "case_id"), ["case_id", "org_id"], "inner")
    return found.join(acts, "case_id", "left").withColumn(
        "actions", F.coalesce("actions", F.array()))
