"""Log files: write text per source, tail them as a stream, load uploads.

``tail_log_files`` is a text file stream labelled with the file it came from
and a fixed ``job`` label (like a log shipper). ``load_uploads`` reads
``*.log``, ``*.txt`` and ``*.out`` line by line, replaces bytes that are no
UTF-8 by U+FFFD, and refuses blank files. No file is held in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPLOAD_GLOB = "*.{log,txt,out}"


def write_log_files(df: DataFrame, path: str, name_col: str, text_col: str) -> str:
    """Text files per ``name_col`` value under ``path/<name_col>=<value>/``; a large source is several files."""
    (df.select(name_col, text_col).hint("rebalance", F.col(name_col)).write.partitionBy(name_col).mode("overwrite")
     .text(path))
    return path


def _source_of(path_col) -> F.Column:
    return F.regexp_extract(path_col, r"/([^/=]+=[^/]+)/[^/]+$", 1)


def tail_log_files(spark: SparkSession, path: str, job: str = "varlogs", glob: str = "*.txt") -> DataFrame:
    """Streaming lines with ``filename`` (partition folder of the file) and ``job`` labels."""
    s = spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    return s.select(F.col("_metadata.file_path").alias("path"), F.lit(job).alias("job"), F.col("value").alias("line"))


def load_uploads(spark: SparkSession, path: str, glob: str = UPLOAD_GLOB) -> DataFrame:
    """Accepted upload files split into lines, with ``refused`` rows for blank files (line NULL)."""
    def source(kind: str):
        return spark.read.format(kind).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")

    file = F.col("_metadata.file_path").alias("path")
    lines = source("text").option("lineSep", "\n").load(path).select(file, F.make_valid_utf8("value").alias("line"))
    visible = F.regexp_replace("line", r"(?U)\s", "") != ""
    accepted = lines.where(visible).select(F.col("path").alias("_path")).distinct()
    blank = (source("binaryFile").load(path).select(file)
             .join(accepted, F.col("path") == F.col("_path"), "left_anti")
             .select("path", F.lit(True).alias("refused"), F.lit(None).cast("string").alias("line")))
    return (lines.join(accepted, F.col("path") == F.col("_path"), "left_semi")
            .select("path", F.lit(False).alias("refused"), "line").unionByName(blank))
