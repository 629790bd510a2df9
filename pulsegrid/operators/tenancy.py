"""Tenant resolution: ingestion keys to org, write org, read scope.

A request presenting a key is accepted only if the key's SHA-256 hex matches
a non-revoked key (fail closed otherwise); its org is that of the key's team
and overrides any org in the body. Trusted requests (no key) write under the
body org, else the default org, and may read every org.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Org used when neither a key nor the body names one.
DEFAULT_ORG = "org-default"


def key_orgs(keys: DataFrame, teams: DataFrame) -> DataFrame:
    t = teams.select(F.col("id").alias("team_id"), F.col("org_id").alias("key_org"))
    return keys.join(t, "team_id", "inner").select(
        F.col("id").alias("key_id"), "key_hash", "key_org", "revoked_at")


def resolve_requests(requests: DataFrame, keys: DataFrame, teams: DataFrame, key_col: str = "api_key") -> DataFrame:
    """Adds key_id, key_org, status (``trusted`` / ``accepted`` / ``revoked`` / ``unknown``)."""
    ko = key_orgs(keys, teams)
    hashed = requests.withColumn("_hash", F.when(F.col(key_col).isNotNull(), F.sha2(F.col(key_col), 256)))
    j = hashed.join(ko, hashed._hash == ko.key_hash, "left")
    status = (F.when(F.col(key_col).isNull(), F.lit("trusted"))
              .when(F.col("key_id").isNull(), F.lit("unknown"))
              .when(F.col("revoked_at").isNotNull(), F.lit("revoked"))
              .otherwise(F.lit("accepted")))
    return j.withColumn("status", status).drop("_hash", "key_hash")


def write_org(resolved: DataFrame, body_org_col: str = "body_org") -> DataFrame:
    ok = resolved.where(F.col("status").isin("trusted", "accepted"))
    key = F.when(F.col("status") == "accepted", F.col("key_org"))
    return ok.withColumn("org_id", F.coalesce(key, F.col(body_org_col), F.lit(DEFAULT_ORG)))


def read_scope(resolved: DataFrame, requested_org_col: str = "requested_org") -> DataFrame:
    """Effective read org: the key's org overrides the request; trusted callers may pass none (all orgs)."""
    ok = resolved.where(F.col("status").isin("trusted", "accepted"))
    key = F.when(F.col("status") == "accepted", F.col("key_org"))
    return ok.withColumn("read_org", F.coalesce(key, F.col(requested_org_col)))


def key_usage(resolved: DataFrame) -> DataFrame:
    """Accepted requests per key and the latest use (``last_used_at``)."""
    return (resolved.where(F.col("status") == "accepted")
            .groupBy("key_id", "key_org").agg(F.count(F.lit(1)).alias("n_requests"),
                                              F.max("ts").alias("last_used_at")))
