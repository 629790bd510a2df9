"""Line dedup, n-gram Jaccard join and embedding near-dedup against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import components, linededup, neardup, ngramjoin

from .conftest import hard_rows, line

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- line dedup

def brute_lines(docs, min_words=50):
    """doc_id -> text without later repeats; ids are unique and not null, texts not null."""
    windows, kept = {}, {}
    for doc_id, text in sorted(docs):
        lines = text.split("\n")
        at = [(p, len(WORD.findall(x))) for p, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for i in range(len(at)):
            total = 0
            for j in range(i, len(at)):
                total += at[j][1]
                if total >= min_words:
                    first, last = at[i][0], at[j][0]
                    content = tuple(lines[p] for p, _ in at[i:j + 1])
                    origin = windows.setdefault(content, (doc_id, first, last))
                    if origin[:2] != (doc_id, first):
                        start = max(first, origin[2] + 1) if origin[0] == doc_id else first
                        gone.update(range(start, last + 1))
        kept[doc_id] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return kept


def test_line_dedup_equals_brute_force(spark):
    rng, docs = random.Random(5), []
    pool = [line(s, rng.choice([2, 5, 9, 20, 55])) for s in range(60)] + ["", "  "]
    for i in range(160):
        lines = [line(1000 + 50 * i + k, rng.choice([3, 12, 40])) for k in range(rng.randint(1, 6))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(len(pool) - 8)
            lines[rng.randint(0, len(lines)):0] = pool[a:a + rng.randint(1, 8)]
        docs.append((i, "\n".join(lines)))
    docs += [(200, "\n".join([line(1, 12)] * 15)), (201, "\n".join([line(1, 12)] * 15)), (202, docs[3][1]), (203, "")]
    got = {r.doc_id: r.text for r in linededup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)
    assert sum(t != d for t, d in zip(got.values(), dict(docs).values(), strict=True)) > 20


def test_line_dedup_hard_rows(hard, empty, clashing):
    for df in (hard, clashing):
        out = linededup.dedup(df)
        assert out.columns == [*df.columns, "_removed"]
        rows = out.collect()
        assert len(rows) == len(hard_rows())
        by_id = {}
        for r in rows:
            by_id.setdefault(r.doc_id, set()).add(r.text)
        para = [line(s, 60) for s in range(6)]
        # the row without an id comes first in order and stays whole
        assert "\n".join(para) in by_id[None] and None in by_id[None]
        assert by_id[7] == by_id[8] == {""} and by_id[9] == {"end here"} and by_id[10] == {""}
        assert by_id[0] == {None} and by_id[1] == {""} and by_id[2] == {" \n\t "} and by_id[6] == {""}
    assert linededup.report(empty).count() == 0


# --- n-gram Jaccard join

def shingle_set(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute_groups(docs):
    sets = {d: shingle_set(t) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), r) for d, r in roots(ids, links).items()}


def near_copies(rng, base, n, most):
    words = base.split(" ")
    for _ in range(n):
        copy = list(words)
        for _ in range(rng.randint(0, most)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10 ** 6)}"
        yield " ".join(copy[:len(copy) - rng.randint(0, 3)])


@pytest.mark.parametrize("small_blocks", [False, True])
def test_ngram_join_equals_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:
        for name, value in (("BLOCK", 5), ("FAMILY_DOCS", 7), ("FAMILY_SHARE", 0.4)):
            monkeypatch.setattr(ngramjoin, name, value)
    rng, texts = random.Random(11), []
    for s, (n, most) in enumerate([(60, 9), (40, 3), (12, 1), (30, 14)]):
        texts += near_copies(rng, line(s, 120 if s else 80), n, most)
    passage = line(77, 60)
    texts += [f"{line(500 + k, rng.randint(1, 90))} {passage} {line(900 + k, rng.randint(1, 40))}" for k in range(60)]
    texts += [f"{passage} {line(300 + k, k % 9)}" for k in range(30)]
    texts += [line(2000 + k, 5 + k % 7) for k in range(40)] + ["a b c", "A  b\nc", "a b c d", "x", "X", "", " "] + texts[:20]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           ngramjoin.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_groups(docs)


def test_filters_lose_no_link():
    for a in range(1, 60):
        for b in range(a, 60):
            need = ngramjoin.overlap_needed(a, b)
            assert need == min((c for c in range(1, 200) if 100 * c >= 75 * (a + b - c)))
            if 4 * a >= 3 * b:  # the prefixes of two sets with this overlap can't both miss it
                assert a - need + 1 <= ngramjoin.prefix_length(a) and b - need + 1 <= ngramjoin.prefix_length(b)


def test_range_counts_reject_no_link():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300, 5000):
        a = np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:n - n // 8], rng.integers(0, 2 ** 64, n // 9, dtype=np.uint64)]))
        assert 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
        assert ngramjoin.may_link(ngramjoin.range_counts(a), ngramjoin.range_counts(b), len(a), len(b))
        c = np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64))
        assert n < 40 or not ngramjoin.may_link(ngramjoin.range_counts(a), ngramjoin.range_counts(c), len(a), len(c))


def test_ngram_join_hard_rows(hard, empty, clashing):
    for df in (hard, clashing):
        rows = ngramjoin.link_components(df).collect()
        assert len(rows) == len(hard_rows())
        groups = {}
        for r in rows:
            groups.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
        assert groups[0] == {(0, 0)} and groups[1] == {(0, 1)} and groups[3] == {(1, 3)}
        assert {c for _, c in groups[5] | groups[6]} == {5}
        assert {c for _, c in groups[7] | groups[8]} == {7}
        assert (356, 7) in groups[None] and (0, None) in groups[None]
    assert ngramjoin.link_components(empty).count() == 0
    kept = sorted((r.doc_id for r in ngramjoin.keep_one(clashing).collect()), key=lambda d: (d is None, d or 0))
    assert kept == [0, 1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 13, None]  # one of each group, and all without words


def test_keep_one_with_null_and_repeated_ids(spark):
    a, b, c = line(1, 60), line(2, 60), line(3, 60)
    rows = [(None, a), (None, f"{a} end"), (None, b), (4, c), (4, c), (4, c),  # no id; alone; repeated rows
            (7, "first text of seven words stands here"), (7, f"{line(5, 60)} x"), (5, line(5, 60)),  # one id, two texts
            (None, None), (None, None), (8, " "), (9, "one"), (None, "one")]
    for frame in (spark.createDataFrame(rows, "doc_id long, text string"),
                  spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, th string, label string")):
        out = ngramjoin.keep_one(frame)
        assert out.columns == frame.columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        pair = [r for r in got if r in rows[:2]]
        assert len(pair) == 1
        assert sorted((r for r in got if r not in rows[:2]), key=repr) == sorted(
            [rows[2], rows[3], rows[6], rows[8], rows[9], rows[10], rows[11], rows[12]], key=repr)


# --- embeddings

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_vectors(rows, cosine=0.95):
    ok = {}
    for vec_id, v, _ in rows:
        if v and vec_id is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(np.float64)
            ok[vec_id] = x / np.linalg.norm(x)
    ids = sorted(i for i, *_ in rows if i is not None)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if a in ok and b in ok and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine]
    root = roots(ids, links)
    return {i: (sum(i in pair for pair in links), root[i], root[i] == i) for i in ids}


@pytest.mark.parametrize("part", [768, 9])
def test_embeddings_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(neardup, "PART", part)
    monkeypatch.setattr(neardup, "CELL", 20)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 16))
    vectors = [*base, *(base[0] + rng.normal(scale=0.12, size=(80, 16))), *(base[rng.integers(0, 120, 100)] * 2.5),
               *(base[rng.integers(0, 120, 100)] + rng.normal(scale=0.2, size=(100, 16))), *[base[1]] * 40]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [None] + [1.0] * 15, 1),
             (n + 4, [float("nan")] * 16, None), (n + 5, [float("inf")] * 16, 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in
           neardup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    want = brute_vectors(rows)
    found, all_links = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert found >= 0.99 * all_links
    if found == all_links:
        assert got == want


def test_embeddings_odd_tables(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [1.0, 0.01], None), (3, None, 1)]
    got = sorted((tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, True), (2, 2, 1, False), (3, 0, 3, True)], key=repr)


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(8)
    x = neardup.unit(rng.normal(size=(300, 10)).tolist())
    grid = neardup.Grid(x, 12)
    a, b = grid._distances(x[:40])
    every = (a[:, :, None] + b[:, None, :]).reshape(40, -1)
    seen = grid.visits(x[:40], 17)
    nearest = np.sort(every, axis=1)[:, :17]
    assert np.allclose(np.sort(np.take_along_axis(every, seen, axis=1), axis=1), nearest)
    assert (seen[:, 0] == grid.home(x[:40])).all()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(50)] + [(7, 7), (3000, 2999)]
    links += [(rng.randrange(4000, 4100), rng.randrange(4000, 4100)) for _ in range(60)]
    rng.shuffle(links)
    nodes = {x for a, b in links for x in (a, b) if a != b}
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in roots(nodes, [x for x in links if x[0] != x[1]]).items()}


def test_components_over_many_partitions(spark, monkeypatch):
    """Rounds end although the links of a chain lie in different partitions that are not coalesced."""
    monkeypatch.setattr(components, "PIECE", 16)
    rng = random.Random(6)
    names = rng.sample(range(10 ** 6), 200)
    links = [*zip(names[:80], names[1:80], strict=False), *((names[80], x) for x in names[81:160])]
    links += [(3, 2), (2, 1)] + [(rng.choice(names[160:]), rng.choice(names[160:])) for _ in range(30)]
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        frame = spark.createDataFrame(links, "a long, b long").repartition(64)
        got = [tuple(r) for r in components.components(frame).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    links = [x for x in links if x[0] != x[1]]
    assert sorted(got) == sorted(roots({x for link in links for x in link}, links).items())


def test_pieces_of_a_large_star_are_bounded():
    star = pa.RecordBatch.from_pydict({"a": list(range(1, 1001)), "b": [0] * 1000})
    pieces = list(components._pieces(iter([star, star.slice(0, 0), star, star.slice(0, 70)]), 64))
    assert max(len(a) for a, _ in pieces) == 64 and sum(len(a) for a, _ in pieces) == 2070
    assert sorted(x for a, _ in pieces for x in a.tolist()) == sorted([*range(1, 1001)] * 2 + [*range(1, 71)])
