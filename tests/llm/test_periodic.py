"""Periodic runs against definitions spelled out in Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import periodic

from .conftest import hard_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and w[end] == w[end + q]:
                end += 1
            length = end - i + q
            if length >= max(6, 4 * q):
                out.setdefault((i, length), q)  # periods rise: the first is the smallest
            i = end + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_report(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_cover_has_every_difference():
    assert {(a - b) % periodic.PERIOD for a in periodic.COVER for b in periodic.COVER} == set(range(periodic.PERIOD))


@pytest.mark.parametrize("letters", [1, 2, 5, 300])
def test_common_prefixes(letters):
    rng = np.random.default_rng(letters)
    words = rng.integers(0, letters, 700)
    words[200:500] = words[:300]
    words = np.concatenate([words, [-2]])
    i, j = rng.integers(0, 700, (2, 3000))
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    got = periodic.CommonPrefixes(words)(i, j)
    for a, b, c in zip(i, j, got):
        assert (words[a:a + c] == words[b:b + c]).all() and words[a + c] != words[b + c]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5))
def test_runs_of_small_alphabets(texts):
    got = periodic.runs([np.array(t, dtype=np.int64) for t in texts])
    assert [[tuple(r) for r in t.tolist()] for t in got] == [sorted(brute_runs(t), key=lambda r: (r[0], r[2])) for t in texts]


def test_long_periods_and_neighbouring_copies():
    rng = random.Random(5)
    texts = []
    for n, p in [(900, 200), (900, 40), (900, 31), (900, 1), (900, 225), (400, 99), (400, 99), (5000, 1200), (6, 1), (5, 1)]:
        block = [rng.randrange(500) for _ in range(p)]
        head = [rng.randrange(500) for _ in range(rng.randrange(n // 5 + 1))]
        texts.append((head + block * (n // p + 1))[:n])
    texts += [texts[0], texts[0], texts[5] + texts[3]]
    got = periodic.runs([np.array(t, dtype=np.int64) for t in texts])
    assert [[tuple(r) for r in t.tolist()] for t in got] == [sorted(brute_runs(t), key=lambda r: (r[0], r[2])) for t in texts]


def test_pairs_tried_in_pieces(monkeypatch):
    text = np.array([1, 2, 3] * 50 + list(range(10, 60)) + [7] * 30)
    want = [t.tolist() for t in periodic.runs([text])]
    monkeypatch.setattr(periodic, "PAIRS", 5)
    assert [t.tolist() for t in periodic.runs([text])] == want == [[list(r) for r in brute_runs(text.tolist())]]


def test_report_of_hard_rows(spark, hard, empty, clashing):
    want = sorted((brute_report(r[0], r[1]) for r in hard_rows()), key=str)
    for df in (hard, clashing):
        assert sorted((tuple(r) for r in periodic.report(df).collect()), key=str) == want
    assert periodic.report(empty).count() == 0


def test_report_of_the_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in periodic.report(docs).collect()), key=str)
    assert got == sorted((brute_report(*r) for r in rows), key=str)
    assert any(r[1] for r in got)


def test_spans_and_texts(spark, hard):
    for r in periodic.find_runs(hard).collect():
        assert all(run.length >= max(6, 4 * run.period) for run in r.runs)
    rows = periodic.find_runs(spark.createDataFrame([(1, "x a b a b a b a b y")], "doc_id int, text string")).collect()
    assert [tuple(x) for x in rows[0].runs] == [(1, 8, 2)] and rows[0].collapsed == "x a b y"
