"""Line dedup by winnowing (DataFrame functions only).

A run of lines is repeated if it has ``min_words`` words or more and occurs earlier in the corpus,
by (doc_id, position). Later repeats are deleted, the first copy stays.

Fingerprints: from every line the shortest window of lines with ``min_words`` words is taken and its
smallest line hash selected. A repeated run holds a whole such window, and the selection depends on
the window's content alone, so both copies have selected the same line: no run can be missed. Only
fingerprints with two positions or more go on. Windows that selected one of them are joined on
fingerprint and content; extension to both sides is by the shortest windows that end at a line
besides those that begin at one, since every line of a repeated run lies in a repeated window of
one of the two kinds. Windows of equal content are compared with the first of them only (a minimum
per content, added up before the shuffle), never pair by pair.

Lines are compared by 128 bits of hash. Lines without a word belong to no run, but go with a run
that is deleted around them. If a window overlaps its own first copy (one line over and over), only
what lies behind that copy is deleted.

Defined results: null text stays null, empty text stays empty; a null doc_id comes first in order;
rows that agree in doc_id and text are one document and are changed alike; an empty table gives no
rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["_doc", "_text"]


def _lines(docs: DataFrame) -> DataFrame:
    """Position, words and hashes of each line that has a word."""
    return (docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"),
                        F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .select(*_KEY, "pos", F.regexp_count("line", F.lit(_WORD)).cast("long").alias("words"),
                    F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
            .where("words > 0")
            .repartition(*_KEY).dropDuplicates([*_KEY, "pos"]))


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """fp, content, first and last line of each shortest window that begins or ends at a line."""
    doc = Window.partitionBy(*_KEY)
    to_here = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ahead = doc.orderBy("start").rangeBetween(0, min_words - 1)
    behind = doc.orderBy("end").rangeBetween(1 - min_words, 0)
    content = F.collect_list(F.struct("h", "g"))
    spans = (lines.withColumn("end", F.sum("words").over(to_here))
             .withColumn("start", F.col("end") - F.col("words"))
             .withColumns({"a_fp": F.min("h").over(ahead), "a_last": F.max("pos").over(ahead),
                           "a_words": F.sum("words").over(ahead), "a_content": content.over(ahead)})
             .withColumns({"b_fp": F.first("a_fp").over(behind), "b_first": F.min("pos").over(behind),
                           "b_words": F.sum("words").over(behind), "b_content": content.over(behind),
                           "b_known": F.first("a_last").over(behind) == F.col("pos")}))
    begins = F.struct(F.col("a_fp").alias("fp"), F.col("a_content").alias("content"), F.col("pos").alias("first"),
                      F.col("a_last").alias("last"), F.col("a_words").alias("words"))
    ends = F.struct(F.col("b_fp").alias("fp"), F.col("b_content").alias("content"), F.col("b_first").alias("first"),
                    F.col("pos").alias("last"),
                    F.when(F.col("b_known"), 0).otherwise(F.col("b_words")).cast("long").alias("words"))
    return (spans.select(*_KEY, F.inline(F.array(begins, ends))).where(F.col("words") >= min_words)
            .select(*_KEY, "fp", F.xxhash64("content").alias("c1"), F.xxhash64(F.lit(1), "content").alias("c2"),
                    "first", "last"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_doc, _text, first and last line of the runs to delete, apart from each other in a document."""
    windows = _windows(_lines(docs), min_words)
    place = F.struct(*_KEY, "first", "last")
    shared = (windows.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
              .where(F.col("lo") != F.col("hi")).select("fp"))
    candidates = windows.join(shared, "fp", "left_semi")
    origin = (candidates.groupBy("c1", "c2").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
              .where(F.col("lo") != F.col("hi")).select("c1", "c2", F.col("lo").alias("origin")))
    same = (F.col("origin._doc").eqNullSafe(F.col("_doc"))) & (F.col("origin._text") == F.col("_text"))
    later = (candidates.join(origin, ["c1", "c2"])
             .withColumn("from", F.when(same, F.greatest("first", F.col("origin.last") + 1)).otherwise(F.col("first")))
             .where(~same | (F.col("first") != F.col("origin.first"))).where(F.col("from") <= F.col("last"))
             .groupBy(*_KEY, F.col("from").alias("first")).agg(F.max("last").alias("last")))
    doc = Window.partitionBy(*_KEY).orderBy("first")
    reach = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    return (later.withColumn("fresh", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int"))
            .withColumn("run", F.sum("fresh").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*_KEY, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
            .drop("run"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows with their columns, text without the repeated runs, and ``_removed``, the lines deleted."""
    runs = (repeated_runs(docs.select("doc_id", "text"), min_words)
            .groupBy(*_KEY).agg(F.collect_list(F.struct("first", "last")).alias("_runs"),
                                F.sum(F.col("last") - F.col("first") + 1).alias("_removed")))
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    joined = keyed.join(runs, F.expr("doc_id <=> _doc AND _hash = _text"), "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, at: ~F.exists(
        "_runs", lambda r: at.between(r["first"], r["last"]))), "\n")
    return joined.select(*[F.when(F.col("_runs").isNull(), F.col("text")).otherwise(rest).alias("text")
                           if c == "text" else F.col(c) for c in docs.columns],
                         F.coalesce("_removed", F.lit(0)).cast("long").alias("_removed"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, text without later repeats, and lines_removed of every document."""
    return dedup(docs.select("doc_id", "text")).withColumnRenamed("_removed", "lines_removed")
