"""Substring dedup against a table of all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import anchors, wordhash

from .conftest import DOCS, hard_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """doc_id, n_words, n_removed, kept words; rows of one doc_id and words are one document."""
    docs = [(r[0], tuple(WORD.findall(r[1] or ""))) for r in rows]

    def order(d):  # as the operator: null first, then a hash of the words among those of one id
        return d[0] is not None, d[0] or 0

    seen, out = {}, {}
    for d in sorted(set(docs), key=lambda d: (order(d), d[1])):
        for i in range(len(d[1]) - 19):
            seen.setdefault(d[1][i:i + 20], (d, i))
    for d in set(docs):
        gone = {j for i in range(len(d[1]) - 19) if seen[d[1][i:i + 20]] != (d, i) for j in range(i, i + 20)}
        left = [x for i, x in enumerate(d[1]) if i not in gone]
        out[d] = (d[0], len(d[1]), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return sorted((out[d] for d in docs), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in anchors.report(df).collect()), key=str)


def test_hard_rows(spark, hard, empty, clashing):
    # two texts share the null id in the hard rows; only one of them has words
    want = brute(hard_rows())
    assert rows_of(hard) == want
    assert rows_of(clashing) == want
    assert rows_of(empty) == []


def test_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(docs.repartition(7)) == brute(docs.select("doc_id", "text").collect())


def shared_passages(seed, letters=400):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(letters)}"
    passages = [[word() for _ in range(r.choice([19, 20, 21, 35, 60]))] for _ in range(12)]
    rows = []
    for i in range(150):
        text = [word() for _ in range(r.randrange(30))]
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            text += p[a:] if r.random() < 0.5 else p
            text += [word() for _ in range(r.randrange(12))]
        rows.append((i, " ".join(text), "en", "s", None))
    rows += [(500 + i, rows[3][1], "en", "s", None) for i in range(60)]  # a large group of copies
    rows += [rows[10], rows[10], (None, rows[11][1], None, None, None), (700, "tie " * 45, "en", "s", 1)]
    return rows


@pytest.mark.parametrize("seed, letters", [(1, 400), (2, 3), (3, 1)])
def test_passages_shared_by_many(spark, seed, letters):
    rows = shared_passages(seed, letters)
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    assert rows_of(df) == brute(rows)


def test_small_buckets_and_sends(spark, monkeypatch):
    for name, value in (("BUCKET", 64), ("SENT", 100)):
        monkeypatch.setattr(anchors, name, value)
    rows = shared_passages(4)
    assert rows_of(spark.createDataFrame(rows, DOCS).repartition(3)) == brute(rows)


def test_one_id_with_several_texts(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"{passage} a{k}", "en", "s", None) for k in range(4)] + [(None, f"b{k} {passage}", "en", "s", None) for k in range(3)]
    got = rows_of(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted(r[2] for r in got) == [0] + [30] * 6  # the passage stays once, with one of the null ids
    assert {r[0] for r in got if r[2] == 0} == {None}


def test_dedup_keeps_columns_and_untouched_texts(spark, clashing):
    out = anchors.dedup(clashing)
    assert out.columns == [*clashing.columns, "_removed"]
    rows = out.collect()
    assert len(rows) == len(hard_rows()) and {r.lines for r in rows} == {"x"}
    was = {(r[0], r[1]) for r in hard_rows()}
    assert all((r.doc_id, r.text) in was for r in rows if r._removed == 0)
    assert sum(r._removed > 0 for r in rows) > 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 42), max_size=40))
def test_codecs(values):
    rising = np.array(sorted(set(values)), dtype=np.uint64)
    assert (anchors.unpack_sorted(anchors.pack_sorted(rising)) == rising).all()
    a, b = rising.view(np.int64), rising.astype(np.uint32).view(np.int32)[::2]
    for x, y in zip(anchors.unsqueeze(anchors.squeeze(a, b), np.int64, np.int32), (a, b)):
        assert (x == y).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tabé漢\x00\x1c", max_size=30)), max_size=8))
def test_word_hashes(texts):
    import pyarrow as pa
    column = pa.array(texts, type=pa.string())
    got = [(int(r), int(h)) for w in wordhash.words_of(column) for r, h in zip(w.row, w.hashes)]
    want = [(i, x) for i, t in enumerate(texts) for x in WORD.findall(t or "")]
    assert [r for r, _ in got] == [i for i, _ in want]
    assert len({h for _, h in got}) == len({x for _, x in want})
    assert len(set(zip((h for _, h in got), (x for _, x in want)))) == len({x for _, x in want})


@pytest.mark.parametrize("k", [1, 2, 5, 10, 20, 31])
def test_rolling_hashes(k):
    w = np.random.default_rng(k).integers(0, 3, 400).astype(np.uint64)
    got = wordhash.rolling(w, k)
    stretches = [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
    assert len(set(zip(got.tolist(), stretches))) == len(set(stretches)) == len(set(got[:len(stretches)].tolist()))


def test_empty_columns_give_no_rows(spark):
    none = spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", 0)], DOCS)
    assert rows_of(none) == brute([(1, None), (2, "")])
    assert anchors.dedup(none.where(F.lit(False))).count() == 0


def test_a_worker_holds_pieces_of_a_task(spark, monkeypatch):
    for name, value in (("PIECE", 500), ("PIECES", 5)):
        monkeypatch.setattr(anchors, name, value, raising=False)
    rows = shared_passages(5)
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    texts = anchors.Texts(df.limit(60).coalesce(1), ["doc_id"])
    held = texts.table.groupBy("_task").agg(F.sum("_n").alias("words"), F.count("*").alias("rows")).collect()
    longest = texts.table.agg(F.max("_n")).first()[0]
    assert 2 < len(held) <= 5 and max(r.words + 8 * r.rows for r in held) <= 2 * (500 + longest + 8)
    assert len({f for f in texts.table.inputFiles()}) == 1  # still one bucket a task
    texts.drop()
    assert rows_of(df) == brute(rows)  # the last pieces share labels


def packed(r, senders, each):
    """Rows as they meet in a bucket of step 3 and of step 4."""
    hashes = [np.unique(r.integers(0, 1 << 40, each, dtype=np.uint64)) for _ in range(senders)]
    anchored = pa.table({"_bucket": pa.array([0] * senders, type=pa.int32()), "_task": list(range(senders)),
                         "_data": [anchors.pack_sorted(h) for h in hashes]})
    sent = []
    for k in range(senders):
        a = np.sort(r.integers(0, 1 << 62, each, dtype=np.uint64))
        row, place = np.sort(r.integers(0, 50, each)), r.integers(0, 500, each).astype(np.int32)
        of, at = np.unique(row, return_inverse=True)
        sent.append((a.tobytes() + (a & np.uint64(0xFF)).astype(np.uint32).tobytes(), anchors.squeeze(
            of + 1000 * k, of * senders - k, 0 * of, np.diff(at, prepend=0).astype(np.int32), place)))
    met = pa.table({"_bucket": pa.array([0] * senders, type=pa.int32()), "_task": list(range(senders)),
                    "_content": [c for c, _ in sent], "_places": [p for _, p in sent],
                    "_later": pa.nulls(senders, pa.binary())})
    return anchored, met


def test_memory_of_a_bucket():
    import tracemalloc

    anchored, met = packed(np.random.default_rng(3), 40, 20_000)
    most = []
    for work, table in ((anchors._hits(8)[0], anchored), (anchors._later, met)):
        tracemalloc.start()
        work(table)
        most.append(tracemalloc.get_traced_memory()[1] / 800_000)
        tracemalloc.stop()
    assert most[0] < 30 and most[1] < 60  # bytes a hash and a window


def test_later_places_by_slices(monkeypatch):
    r = np.random.default_rng(4)
    tables, rows = [], []
    for k in range(7):
        a, row = r.integers(0, 60, 40).astype(np.uint64) << np.uint64(56), np.sort(r.integers(0, 9, 40))
        b, place = r.integers(0, 2, 40).astype(np.uint32), r.permutation(40).astype(np.int32)
        of, at = np.unique(row, return_inverse=True)
        rows += [(int(x), int(y), 100 * (20 - k) + int(d) - 50, k, 1000 * k + int(d), int(p))
                 for x, y, d, p in zip(a, b, row, place, strict=True)]
        step = np.diff(at, prepend=0).astype(np.int32)
        places = anchors.squeeze(of + 1000 * k, 100 * (20 - k) + of - 50, 0 * of, step, place)
        tables.append(pa.table({"_task": [k], "_content": [a.tobytes() + b.tobytes()], "_places": [places],
                                "_later": pa.nulls(1, pa.binary())}))
    want, seen = set(), set()
    for x, y, doc, k, row, place in sorted(rows, key=lambda t: (t[2], t[5])):
        if (x, y) in seen:
            want.add((k, row, place))
        seen.add((x, y))
    for size in (1 << 18, 16):
        monkeypatch.setattr(anchors, "SLICE", size, raising=False)
        told = anchors._later(pa.concat_tables(tables))
        got = {(t, int(row), int(p)) for t, d in zip(told["_task"].to_pylist(), told["_data"].to_pylist(), strict=True)
               for row, p in zip(*anchors.unsqueeze(d, np.int64, np.int32), strict=True)}
        assert got == want
