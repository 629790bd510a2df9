"""Quality rules: word and line statistics, and bands of n-gram perplexity for each language.

The perplexities of a text come from one modified Kneser-Ney model over all documents, with letters of
all scripts as symbols of their own: by 5-grams, which tell words in disorder from prose, and by its
4-grams, which tell tables and symbol noise that repeat. For every language the median of each log
perplexity and its median absolute deviation, taken over the documents that pass the base rules, give
a lower and an upper bound; documents outside either are rejected (below: formulaic or generated text,
above: word salad, tables, other languages).

Defined results: null and empty texts have no words, no perplexity, and fail the base rules; a null
language is a language of its own; repeated rows are judged one by one; with an empty table nothing
is returned; a language's band is never narrower than LEAST_OFF allows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kneserney
from .common import keep

MIN_WORDS = 50
MAX_REPEATED = 50   # per cent of words in repeated 3-word windows
BELOW = 4.25        # bounds in robust deviations from the language's median
ABOVE = 4.75
LEAST_OFF = 0.01    # least median deviation, for languages of a few documents
_SPREAD = 1.4826    # deviation of a normal distribution by its median absolute deviation

_SYMBOLS = np.zeros(128, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

STATISTICS = T.StructType([T.StructField("_q", T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("log_perplexity", T.DoubleType()),
    T.StructField("short_perplexity", T.DoubleType())]))])


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = total = 0  # words before ``covered`` are counted
    for at, window in enumerate(windows):
        if seen[window] > 1:
            total += at + 3 - max(covered, at)
            covered = at + 3
    return total


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def statistics(text: str | None, model: kneserney.Model) -> dict:
    text = text or ""
    points, raw = kneserney.code_points(text), text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = np.count_nonzero((points == 32) | ((points >= 9) & (points <= 13)))
    return {"n_words": len(words), "word_chars": len(points) - int(blanks),
            "n_symbols": int(np.count_nonzero(_SYMBOLS[points[points < 128]])),
            "n_dup_lines": repeated_lines(raw), "n_repeat_words": repeated_words(words),
            "log_perplexity": model.log_perplexities(points)}


def measure(docs: DataFrame, model: kneserney.Model, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of each row with its statistics in the struct ``_q``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # an entry for each distinct n-gram
    schema = T.StructType([docs.schema[c] for c in carry] + STATISTICS.fields)
    columns = list(dict.fromkeys([*carry, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                          ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
                          ("log_perplexity", pa.float64()), ("short_perplexity", pa.float64())])
        for batch in batches:
            stats = [statistics(t.as_py(), shared.value) for t in batch.column("text")]
            for s in stats:
                s["log_perplexity"], s["short_perplexity"] = s["log_perplexity"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(stats, type=kind)],
                                             names=[*carry, "_q"])

    return docs.select(*columns).mapInArrow(run, schema)


def base_failed():
    q = F.col("_q")
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED * q["n_words"])


def bands(measured: DataFrame) -> DataFrame:
    """_language, _lower, _upper, _short_lower and _short_upper: bounds of the log perplexities."""
    sound = measured.where(~base_failed()).select(F.col("lang").alias("_language"), F.col("_q.log_perplexity").alias("_x"),
                                                  F.col("_q.short_perplexity").alias("_y"))
    middle = (sound.groupBy("_language").agg(F.percentile_approx("_x", 0.5, 10000).alias("_mx"),
                                             F.percentile_approx("_y", 0.5, 10000).alias("_my"))
              .withColumnRenamed("_language", "_of"))
    off = (sound.join(middle, F.expr("_language <=> _of"))
           .select("_language", "_mx", "_my", F.abs(F.col("_x") - F.col("_mx")).alias("_dx"),
                   F.abs(F.col("_y") - F.col("_my")).alias("_dy")))
    off = off.groupBy("_language").agg(
        F.first("_mx").alias("_mx"), F.first("_my").alias("_my"),
        F.greatest(F.percentile_approx("_dx", 0.5, 10000), F.lit(LEAST_OFF)).alias("_dx"),
        F.greatest(F.percentile_approx("_dy", 0.5, 10000), F.lit(LEAST_OFF)).alias("_dy"))

    def bound(median: str, deviations: float, deviation: str, name: str):
        return (F.col(median) + deviations * _SPREAD * F.col(deviation)).alias(name)

    return off.select("_language", bound("_mx", -BELOW, "_dx", "_lower"), bound("_mx", ABOVE, "_dx", "_upper"),
                      bound("_my", -BELOW, "_dy", "_short_lower"), bound("_my", ABOVE, "_dy", "_short_upper"))


def judge(docs: DataFrame, carry: list[str] | None = None, order: int = kneserney.ORDER,
          classes: int = kneserney.WHOLE) -> DataFrame:
    """The columns ``carry`` (by default all) of each row with ``_q``, ``_base_failed`` and ``_kept``.

    docs needs text and lang. Rows are measured once and written with what they carry; the bands
    come from the written values, so the verdicts are the same whoever reads them again.
    """
    carry = list(docs.columns) if carry is None else carry
    model = kneserney.train(docs, order, classes)
    measured = keep(measure(docs, model, list(dict.fromkeys([*carry, "lang"]))), "quality-rules")
    inside = F.coalesce(F.col("_q.log_perplexity").between(F.col("_lower"), F.col("_upper"))
                        & F.col("_q.short_perplexity").between(F.col("_short_lower"), F.col("_short_upper")), F.lit(False))
    limits = keep(bands(measured), "perplexity-bands")  # a file of known size: the planner needn't move the texts
    return (measured.join(limits, F.expr("lang <=> _language"), "left")
            .withColumn("_base_failed", base_failed())
            .withColumn("_kept", ~F.col("_base_failed") & inside)
            .select(*carry, "_q", "_base_failed", "_kept"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: statistics and verdict."""
    q = F.col("_q")
    return judge(docs.select("doc_id", "lang", "text"), ["doc_id"]).select(
        "doc_id", q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"),
        q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"),
        q["n_repeat_words"].alias("n_repeat_words"), F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"), q["log_perplexity"].alias("log_perplexity"))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judge(docs).where("_kept").select(*docs.columns)
