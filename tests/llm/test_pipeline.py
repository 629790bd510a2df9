"""The corpus pipeline stage by stage."""

import corpus_pipeline
from pulsegrid.llm.common import keep

from .conftest import DOCS, hard_rows
from .test_dedup import brute_groups, brute_lines
from .test_tokens import check_pieces

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, columns, before = [], docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF), "stage")
        names.append(name)
        if name == "packing":
            check_pieces(docs.collect(), list(before.items()))
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(after) and set(after) <= set(before)
        if name in ("quality_rules", "quality_classifier"):
            assert all(after[d] == before[d] for d in after)
            clean = [d for d in before if labels.get(d) == 1 and len((before[d] or "").split()) >= 50]
            assert sum(d in after for d in clean) > 0.95 * len(clean)
        elif name == "line_dedup":
            want = {d: t for d, t in brute_lines(list(before.items())).items() if t.split() or t == before[d]}
            assert after == want
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text != before[r.doc_id])
        else:
            assert set(after) == {d for d, (_, root) in brute_groups(list(before.items())).items() if d == root}
        before = after
    assert names == ["quality_rules", "quality_classifier", "line_dedup", "ngram_jaccard", "packing"]


def test_run_returns_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0


def test_stages_take_hard_and_empty_tables(spark, hard, empty, clashing):
    for docs in (hard, clashing, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            if name != "packing":
                assert out.columns == docs.columns and n <= len(hard_rows())
    assert empty.schema.simpleString() == spark.createDataFrame([], DOCS).schema.simpleString()
