"""Static remediation-action catalog (loaded idempotently by unique name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The seed catalog of remediation actions, (name, action_type, description), ids 1..14 in order.
ACTIONS = [
    ("Rollback last deployment", "rollback",
     "Roll back the affected service to its previous deployed version to undo a bad deployment "
     "that is causing cascading failures across dependent services."),
    ("Raise PR: revert suspected bad commit", "raise_pr",
     "Open a pull request reverting the most recent merged change suspected of causing the incident."),
    ("Reset payment gateway circuit breaker", "config_change",
     "The payment gateway circuit breaker is OPEN and blocking all traffic; reset it and re-enable "
     "outbound calls to the payment provider."),
    ("Failover to backup payment provider", "config_change",
     "Payment gateway is unreachable; switch payment processing to the backup provider until the "
     "primary gateway recovers."),
    ("Rotate JWT signing keys", "config_change",
     "JWT validation is failing with expired/invalid tokens; rotate the signing keys and force "
     "re-authentication."),
    ("Block suspicious source IPs", "config_change",
     "Repeated failed authentication attempts from the same IP addresses; add them to the block list."),
    ("Scale database connection pool", "config_change",
     "Database connection pool is exhausted with requests queued and timing out; increase the pool's "
     "max capacity."),
    ("Restart order-service instances", "restart",
     "Restart the affected service's instances to clear a stuck connection pool or memory pressure."),
    ("Run compensating stock-reconciliation job", "restart",
     "Inventory oversell/race condition detected; run the compensating transaction job to reconcile "
     "stock counts."),
    ("Raise PR: add row-level locking for inventory", "raise_pr",
     "Open a pull request adding row-level locking around inventory stock decrements to prevent "
     "concurrent oversell."),
    ("Scale out product-service instances", "config_change",
     "p99 latency has breached SLA with elevated error rates; add more instances to spread load."),
    ("Disable retry-storm amplification", "config_change",
     "Retry storm is amplifying load on an already-degraded service; reduce or disable client retries."),
    ("Raise memory limit and restart pod", "restart",
     "Heap usage is climbing toward an out-of-memory condition; raise the memory limit and restart "
     "the pod."),
    ("Switch to backup shipping provider", "config_change",
     "The primary shipping API is unreachable and webhook deliveries are failing; switch to the "
     "backup shipping provider."),
]


def actions_frame(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, n, t, d) for i, (n, t, d) in enumerate(ACTIONS)]
    return spark.createDataFrame(rows, "id int, name string, action_type string, description string")


def load_actions(existing: DataFrame, spark: SparkSession) -> DataFrame:
    """Idempotent load: only catalog rows whose name is not present yet (``ON CONFLICT (name) DO NOTHING``)."""
    new = actions_frame(spark).join(existing.select("name"), "name", "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def action_types_sql() -> str:
    """The catalog as a SQL VALUES list (for oracles)."""
    vals = ", ".join(f"({i + 1}, '{n}', '{t}')" for i, (n, t, _) in enumerate(ACTIONS))
    return f"(VALUES {vals}) AS actions(id, name, action_type)"


def actions_sql(alias: str = "a") -> str:
    """The catalog with descriptions as a SQL VALUES list (for oracles)."""
    def q(x):
        return "'" + x.replace("'", "''") + "'"
    vals = ", ".join(f"({i + 1}, {q(n)}, {q(t)}, {q(d)})" for i, (n, t, d) in enumerate(ACTIONS))
    return f"(VALUES {vals}) AS {alias}(id, name, action_type, description)"


def lit_actions(spark: SparkSession) -> DataFrame:
    return actions_frame(spark).select("id", "name", "action_type", F.col("description"))
