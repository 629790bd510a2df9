"""Text embeddings and action matching.

The default embedder is deterministic and JVM-side: Unicode word tokens,
feature hashing into ``dim`` buckets, L2 normalisation. A hosted model can be
injected as a ``pandas_udf`` returning ``array<float>`` (batched through
Arrow; retries and back-off belong inside it).
"""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similarity

# Vector size of the case index.
DEFAULT_DIM = 1024
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"


def embed_text(df: DataFrame, text_col: str, out_col: str = "vector", dim: int = DEFAULT_DIM,
               embedder=None) -> DataFrame:
    if embedder is not None:
        return df.withColumn(out_col, embedder(F.col(text_col)))
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_SPLIT, toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    nrm = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0)
    src = df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    out = nrm.transform(tf.transform(tok.transform(src)))
    return out.withColumn(out_col, vector_to_array("_nv", "float32")).drop("_tok", "_tf", "_nv")


def rebuild_vectors(cases: DataFrame, dim: int = DEFAULT_DIM, embedder=None) -> DataFrame:
    """Case vectors re-derived from stored signature texts (the index is a derived table)."""
    c = cases.where(F.col("signature_text").isNotNull()).select("id", "org_id", "primary_service",
                                                                "signature_text")
    return embed_text(c, "signature_text", dim=dim, embedder=embedder)


def live_index(index: DataFrame) -> DataFrame:
    """Vectors that hold now: of each case the row of the last version, unless that is a tombstone."""
    rest = [c for c in index.columns if c != "case_id"]
    last = index.groupBy("case_id").agg(F.max_by(F.struct(*rest), F.col("version")).alias("r"))
    return last.select("case_id", "r.*").where("NOT gone")


def index_changes(index: DataFrame | None, cases: DataFrame, version: int, whole: bool = False, dim: int = DEFAULT_DIM,
                  embedder=None) -> DataFrame:
    """Rows that bring a vector index up to date: case_id, org_id, service, digest, gone, vector, version.

    ``index`` holds the rows appended so far (None: none yet), ``cases`` the cases that may have changed
    (id, org_id, primary_service, signature_text; ids are distinct). Only new cases and those whose signature,
    org or service differs are embedded; an unchanged case gives no row, so adding twice adds nothing. A case
    without a signature that is in the index gets a tombstone, and so does, if ``cases`` are ``whole``, a case
    that is not among them. Appending the rows gives the same ``live_index`` as a rebuild. One join by
    case id, without vectors; ``version`` is above all earlier ones.
    """
    known = (live_index(index).select("case_id", F.struct("org_id", "service", "digest").alias("_old")) if index is not None
             else cases.select(F.col("id").alias("case_id"), F.struct("org_id", F.col("primary_service").alias("service"),
                                                                      F.lit("").alias("digest")).alias("_old")).limit(0))
    now = cases.select(F.col("id").alias("case_id"), "signature_text",
                       F.struct("org_id", F.col("primary_service").alias("service"),
                                F.sha2("signature_text", 256).alias("digest")).alias("_new"))
    both = known.join(now, "case_id", "full_outer" if whole else "right")
    signed = F.col("signature_text").isNotNull()
    added = both.where(signed & ~F.col("_new").eqNullSafe(F.col("_old"))).select("case_id", "_new.*", "signature_text")
    gone = both.where(~signed & F.col("_old").isNotNull()).select("case_id", "_old.*", F.lit(True).alias("gone"),
                                                                  F.lit(None).cast("array<float>").alias("vector"))
    vectors = (embed_text(added, "signature_text", dim=dim, embedder=embedder)
               .select("case_id", "org_id", "service", "digest", F.lit(False).alias("gone"),
                       F.col("vector").cast("array<float>").alias("vector")))
    return vectors.unionByName(gone).withColumn("version", F.lit(version))


def action_vectors(actions: DataFrame, dim: int = DEFAULT_DIM, embedder=None) -> DataFrame:
    return embed_text(actions.select("id", "name", "description"), "description", dim=dim, embedder=embedder)


def match_actions(cases: DataFrame, actions: DataFrame, k: int = 3, dim: int = DEFAULT_DIM,
                  embedder=None) -> DataFrame:
    """Top-k catalog actions per summarized case by similarity of ``title + ' ' + ai_summary``.

    An empty catalog yields no rows, so those cases stay in the match queue.
    """
    c = cases.select(F.col("id").alias("case_id"),
                     F.concat_ws(" ", F.coalesce("title", F.lit("None")), F.coalesce("ai_summary", F.lit("None")))
                     .alias("text"))
    cv = embed_text(c, "text", dim=dim, embedder=embedder)
    av = action_vectors(actions, dim=dim, embedder=embedder)
    top = similarity.exact_topk(cv, av, k, q_id="case_id", i_id="id")
    return top.select(F.col("query_id").alias("case_id"), F.col("match_id").alias("action_id"), "score", "rank")
