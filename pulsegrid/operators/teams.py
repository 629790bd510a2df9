"""Teams, users and organisations: routing, membership, visibility and counts.

Teams and users are dimensions; the planner chooses their join from statistics. Visibility is computed from per-(org, service) case counts joined to
users, never by pairing users with cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


UNASSIGNED = "Unassigned"


def service_owner(teams: DataFrame) -> DataFrame:
    """(org_id, service, team): the first team by name whose services contain the service."""
    return (teams.select("org_id", "name", F.explode("services").alias("service"))
            .groupBy("org_id", "service").agg(F.min("name").alias("team")))


def route(df: DataFrame, teams: DataFrame, service_col: str = "primary_service") -> DataFrame:
    owners = service_owner(teams).withColumnRenamed("service", "_svc")
    out = df.join(owners.withColumnRenamed("org_id", "_org"),
                  (F.col("org_id") == F.col("_org")) & (F.col(service_col) == F.col("_svc")), "left")
    return out.withColumn("team", F.coalesce(F.col("team"), F.lit(UNASSIGNED))).drop("_org", "_svc")


def users_with_teams(users: DataFrame, teams: DataFrame) -> DataFrame:
    t = teams.select(F.col("id").alias("team_id"), F.col("org_id").alias("_torg"),
                     F.col("name").alias("team_name"), F.col("services").alias("team_services"))
    out = users.join(t, (users.team_id == t.team_id) & (users.org_id == t._torg), "left")
    return out.select(users.id, users.name, users.role, users.team_id, users.org_id, "team_name",
                      "team_services").orderBy(F.col("role").desc(), F.col("name"))


def services_for_teams(teams: DataFrame, team_ids=None) -> DataFrame:
    """Per org: sorted distinct services across the (optionally given) teams."""
    t = teams if team_ids is None else teams.where(F.col("id").isin(list(team_ids)))
    return (t.select("org_id", F.explode("services").alias("service")).distinct()
            .groupBy("org_id").agg(F.array_sort(F.collect_list("service")).alias("services")))


def org_overview(orgs: DataFrame, teams: DataFrame, users: DataFrame) -> DataFrame:
    tc = teams.groupBy("org_id").agg(F.count(F.lit(1)).alias("team_count"))
    uc = users.groupBy("org_id").agg(F.count(F.lit(1)).alias("user_count"))
    return (orgs.join(tc, "org_id", "left").join(uc, "org_id", "left")
            .select("org_id", F.coalesce("team_count", F.lit(0)).alias("team_count"),
                    F.coalesce("user_count", F.lit(0)).alias("user_count")))


def org_detail(orgs: DataFrame, teams: DataFrame, users: DataFrame) -> DataFrame:
    tl = teams.groupBy("org_id").agg(F.array_sort(F.collect_list(F.struct("name", "id", "services")))
                                     .alias("teams"))
    ul = users.groupBy("org_id").agg(F.count(F.lit(1)).alias("user_count"),
                                     F.min(F.struct("name", "id")).alias("first_user"))
    return orgs.join(tl, "org_id", "left").join(ul, "org_id", "left")


def org_entries(orgs: DataFrame, teams: DataFrame, users: DataFrame) -> DataFrame:
    """Teams and users of each org with their details, one row each: org_id, kind, id, name, role, services.

    Users are rows and no list in their org's row, since an org may hold any share of them; an org without
    teams and users has no rows, entries of unknown orgs are left out.
    """
    no_list, no_text = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    both = teams.select("org_id", F.lit("team").alias("kind"), "id", "name", no_text.alias("role"), "services").unionByName(
        users.select("org_id", F.lit("user").alias("kind"), "id", "name", "role", no_list.alias("services")))
    return both.join(orgs.select("org_id"), "org_id", "left_semi")


def visible_case_counts(users: DataFrame, teams: DataFrame, cases: DataFrame,
                        admin_role: str = "org_admin") -> DataFrame:
    """Cases each user may list: admins and members whose teams list no services see the whole org."""
    per_svc = cases.groupBy("org_id", F.col("primary_service").alias("service")).agg(
        F.count(F.lit(1)).alias("n"))
    per_org = per_svc.groupBy("org_id").agg(F.sum("n").alias("org_n"))
    t = teams.select(F.col("id").alias("team_id"), F.col("org_id").alias("_torg"), "services")
    u = users.join(t, (users.team_id == t.team_id) & (users.org_id == t._torg), "left") \
        .select(users.id.alias("user_id"), users.org_id, users.role,
                F.coalesce(F.col("services"), F.array().cast("array<string>")).alias("services"))
    narrowed = u.where((F.col("role") != admin_role) & (F.size("services") > 0))
    by_svc = (narrowed.select("user_id", "org_id", F.explode(F.array_distinct("services")).alias("service"))
              .join(per_svc, ["org_id", "service"], "left")
              .groupBy("user_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_visible")))
    whole = (u.where((F.col("role") == admin_role) | (F.size("services") == 0))
             .join(per_org, "org_id", "left")
             .select("user_id", F.coalesce("org_n", F.lit(0)).alias("n_visible")))
    return by_svc.unionByName(whole)
