"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.session import prepare

from . import (anchors, centroids, classifier, htmltext, linededup, neardup, ngramjoin, packing, periodic, pieces, rules,
               tokencounts, urlfilter)
from .common import read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return classifier.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(read(prepare(spark), sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(prepare(spark), sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(prepare(spark), sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(urlfilter.RULES), "host string, path string, verdict string")
    return urlfilter.judge(read(prepare(spark), sf_dir, "pages"), rules)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(read(prepare(spark), sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(read(prepare(spark), sf_dir, "documents"))


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(prepare(spark), sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(read(prepare(spark), sf_dir, "documents")))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.link_components(read(prepare(spark), sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(read(prepare(spark), sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(read(prepare(spark), sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.report(read(prepare(spark), sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_quality_rules, op3_sentencepiece, op4_html_extraction, op5_url_filter,
    op6_line_dedup, op7_token_counts, op8_embedding_neardup, op9_packing, op10_ngram_jaccard, op11_centroid_clustering, op12_periodic_runs,
    op13_substring_dedup)}

# a round of op11: nearest centroids (structs are compared by distance, then number), then floors of the exact means
_NEAREST = """a{i} AS MATERIALIZED (SELECT v.n, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x,
  min({{'d': list_sum(list_transform(range(1, {dim} + 1), lambda i: (v.x[i] - k.x[i]) * (v.x[i] - k.x[i]))), 'c': k.c}}) AS near
  FROM v CROSS JOIN c{i} k GROUP BY v.n)"""
_ROUND = _NEAREST + """,
s{j} AS (SELECT c, pos, sum(y) AS s, count(*) AS n FROM (SELECT near.c AS c, unnest(x) AS y, unnest(range({dim})) AS pos FROM a{i})
  GROUP BY c, pos),
m{j} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS x FROM s{j} GROUP BY c),
c{j} AS MATERIALIZED (SELECT k.c, coalesce(m.x, k.x) AS x FROM c{i} k LEFT JOIN m{j} m ON m.c = k.c),
"""

ORACLE_SQL = {
    "op5_url_filter": """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT row_number() OVER () AS n, page_id,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT n, page_id,
  translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2) AS path FROM cut)
SELECT p.page_id, p.host, p.path, max_by(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule,
  coalesce(max_by(rverdict, length(rhost || rpath) * 1000 + length(rhost)), 'allow') AS verdict
FROM parts p LEFT JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
GROUP BY p.n, p.page_id, p.host, p.path""",
    "op6_line_dedup": """
WITH lines AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)),
ends AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS e FROM lines WHERE words > 0),
spans AS (SELECT doc_id, pos,
  list(line) OVER a AS a_content, max(pos) OVER a AS a_last, sum(words) OVER a AS a_words,
  list(line) OVER b AS b_content, min(pos) OVER b AS b_first, sum(words) OVER b AS b_words
  FROM (SELECT *, e - words AS s FROM ends)
  WINDOW a AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
         b AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
windows AS (SELECT DISTINCT * FROM (
  SELECT doc_id, pos AS i, a_last AS j, a_content AS content FROM spans WHERE a_words >= 50
  UNION ALL SELECT doc_id, b_first, pos, b_content FROM spans WHERE b_words >= 50)),
placed AS (SELECT *, first_value({'doc_id': doc_id, 'i': i, 'j': j}) OVER (PARTITION BY content ORDER BY doc_id, i, j) AS o
  FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(CASE WHEN o.doc_id = doc_id THEN greatest(i, o.j + 1) ELSE i END, j)) AS pos
  FROM placed WHERE o.doc_id <> doc_id OR o.i <> i)
SELECT d.doc_id, CASE WHEN count(g.pos) = 0 THEN any_value(d.text)
    ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') END AS text,
  count(g.pos) AS lines_removed
FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
GROUP BY d.doc_id""",
    "op10_ngram_jaccard": """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op8_embedding_neardup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.other),
lowest AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT l.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, l.vec_id = l.component_id AS kept
FROM lowest l LEFT JOIN degree d ON d.x = l.vec_id""",
    "op11_centroid_clustering": f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {centroids.COMPONENTS}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id), vec_id, x) - 1 AS c, x FROM v
  QUALIFY c < {centroids.CENTROIDS}),
{"".join(_ROUND.format(i=i, j=i + 1, dim=centroids.COMPONENTS) for i in range(centroids.ROUNDS))}
{_NEAREST.format(i=centroids.ROUNDS, dim=centroids.COMPONENTS)},
parts AS (SELECT near.c, sum(near.d)::BIGINT AS s FROM a{centroids.ROUNDS} GROUP BY near.c)
SELECT a.vec_id, near.c::INTEGER AS cluster, near.d::BIGINT AS distance, p.s AS cluster_inertia,
  (SELECT sum(s)::BIGINT FROM parts) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} a JOIN parts p ON p.c = near.c JOIN c{centroids.ROUNDS} k ON k.c = near.c""",
    "op13_substring_dedup": """
WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 20], ' ')) AS content
  FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM words WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM again),
cut AS (SELECT doc_id, count(*) AS n, list(pos) AS p FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN c.n IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(c.p, k - 1)) END, ' '))
    AS kept_sha256
FROM words d LEFT JOIN cut c ON c.doc_id = d.doc_id""",
}
