"""Corpus pipeline: quality rules, quality classifier, line dedup, n-gram Jaccard join, packing.

Each stage works on all documents that the stage before kept; its result is written as Parquet to
the shared checkpoint folder and read again. All stages but the last return the columns of the
documents table; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import classifier, linededup, ngramjoin, packing, rules
from pulsegrid.llm.common import keep, read
from pulsegrid.session import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    prepare(spark)
    return rules.filtered(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    prepare(spark)
    return classifier.filtered(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines; documents of which no word is left go."""
    prepare(spark)
    rest = linededup.dedup(docs).where((F.col("_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rest.select(*[F.when(F.col("_removed") > 0, F.length("text").cast(docs.schema[c].dataType))
                         .otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepare(spark)
    return ngramjoin.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of fixed length."""
    prepare(spark)
    return packing.piece_digests(packing.pack(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("packing", pack),
]

#: No SQL has the models, the tokenizer and the scores; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
