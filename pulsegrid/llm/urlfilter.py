"""URL rules as a sorted sweep over reversed-host keys (DataFrame functions only).

A host becomes its labels in reverse, each closed by a dot (``www.example.com`` is
``com.example.www.``), so a rule's host and all its subdomains are one interval of keys, and the
intervals of all rules are nested or disjoint. At the start and end of every interval the stack of
active rules is known from the rules alone; these events are sorted among the urls' keys by range
partitions, and each url takes the stack of the last event before it. The stack that a partition
inherits comes from one row per partition. Equal keys are dealt over partitions by the url's hash,
so a host with a third of all rows is only many short partitions.

The stack has one entry per rule of the url's own host and its parent domains; the rules whose path
starts the url's path are kept and the longest text wins (then the longer host).

Defined results: null urls and urls without ``://`` have an empty host and path and get the default
verdict; repeated rows are judged one by one; no rules: every row gets the default; an empty table
gives no rows; other columns pass by unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

DEFAULT = "allow"
#: Host, path and verdict of each rule.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
_STACK = "array<struct<length:int,host_length:int,path:string,rule:string,verdict:string>>"


def split_url(docs: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return docs.withColumns({"host": F.translate(F.regexp_extract(url, _PARTS, 1), upper, lower),
                             "path": F.regexp_extract(url, _PARTS, 2)})


def _key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _events(rules: DataFrame) -> DataFrame:
    """Start and end of each rule host's interval with the stack that holds from there on."""
    own = rules.groupBy("host").agg(F.collect_set(F.struct(
        (F.length("host") + F.length("path")).cast("int").alias("length"),
        F.length("host").cast("int").alias("host_length"),
        "path", F.concat("host", "path").alias("rule"), "verdict")).alias("own"))
    labels = F.split("host", r"\.")
    above = own.select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("parent"))
    stacks = (above.join(own.select(F.col("host").alias("parent"), "own"), "parent")
              .groupBy("host").agg(F.flatten(F.collect_list("own")).alias("stack"),
                                   F.flatten(F.collect_list(F.when(F.col("parent") != F.col("host"), F.col("own"))))
                                   .alias("outer")))
    key = _key(F.col("host"))
    opens = stacks.select(key.alias("key"), "stack")
    # "/" follows "." and occurs in no host: the end of all keys that begin with this one
    closes = stacks.select(F.concat(F.substring(key, 1, F.length(key) - 1), F.lit("/")).alias("key"),
                           F.col("outer").alias("stack"))
    return opens.unionByName(closes)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; rules: host, path, verdict."""
    urls = split_url(pages.select("page_id", "url")).select(
        "page_id", "host", "path", _key(F.col("host")).alias("key"), F.lit(1).alias("kind"),
        F.xxhash64("page_id", "url").alias("deal"), F.lit(None).cast(_STACK).alias("stack"))
    events = _events(rules).select(
        F.lit(None).cast("long").alias("page_id"), F.lit("").alias("host"), F.lit("").alias("path"), "key",
        F.lit(0).alias("kind"), F.lit(0).cast("long").alias("deal"), F.col("stack").cast(_STACK).alias("stack"))
    ordered = keep(urls.withColumn("page_id", F.col("page_id").cast("long")).unionByName(events)
                   .repartitionByRange("key", "kind", "deal").withColumn("part", F.spark_partition_id()), "url-sweep")

    inside = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: the last event in it, carried on to the next ones
    carried = (ordered.groupBy("part")
               .agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("closing"))
               .select("part", F.last("closing", ignorenulls=True).over(before).alias("inherited")))
    swept = (ordered.withColumn("active", F.last("stack", ignorenulls=True).over(inside))
             .where(F.col("kind") == 1).join(carried, "part"))
    fitting = F.filter(F.coalesce("active", "inherited", F.array().cast(_STACK)),
                       lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(fitting)
    return swept.select("page_id", "host", "path", best["rule"].alias("rule"),
                        F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))
