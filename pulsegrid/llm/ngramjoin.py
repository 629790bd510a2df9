"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, one verification.

Sets are the distinct 64-bit hashes of a text's 5-word shingles; texts with equal sets are one class
and take part once. All shingles are ordered by how often their counting slot is used in the whole
corpus (2 ** 18 slots counted over all documents), then by hash, rare first. Two sets with a Jaccard
similarity of 0.75 or more share a shingle among the first |x| - ceil(0.75 |x|) + 1 of each.

1. Prefix shingles with two classes or more are the posting lists, sorted by set size.
2. Families: classes that are neighbours in a good share of their lists (each entry of a list has the
   first entry of its size range for a neighbour). A family is only a way to handle many mutual
   candidates without a row per pair: its sets are compared all with all in parts of bounded size,
   which some pivots tie together; members outside the largest component so far are compared with
   the whole family. A part returns a spanning forest of the links it found.
3. Pairs of different families in a list pass the length and positional filters; each pair is then
   kept once, passes the suffix filter (a bound of the set difference by counts in hash ranges of 4
   to 8 shingles on average) and is verified once with the whole sets.
4. Components of all links.

Lists longer than a block are joined block by block. Any split into families gives the same result.

Defined results: null or wordless texts have an empty set and are linked with nothing; a text of
fewer than 5 words is one shingle; equal texts are in one component; rows with a null doc_id take
part in links, but no component is named after them unless all its ids are null; repeated rows are
returned as often as they come; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import components, local_labels

WORDS = 5
SLOTS = 1 << 18
BLOCK = 4096           # entries of a posting list that meet in one task
FAMILY_DOCS = 1024     # sets in a part of a family, on average
PIVOTS = 16            # members of a large family that are compared with all its parts, on average
FAMILY_SHINGLES = 1_500_000
FAMILY_SHARE = 0.1     # of the shorter prefix, in lists where two classes are neighbours

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2 ** 63, 256, dtype=np.uint64) | _U(1)
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    """The first n powers of the base, at least."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles (all words as one, if fewer)."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    word = ~_BLANK[raw]
    at = np.flatnonzero(word)
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))  # of each word, in ``at``
    size = np.diff(np.concatenate([first, [len(at)]]))
    inside = np.arange(len(at)) - np.repeat(first, size)
    words = _mix(np.add.reduceat(_BYTE[raw[at]] * _power(int(size.max()))[inside], first) + size.astype(np.uint64))
    k = min(WORDS, len(words))
    out = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = out * _STEP + words[j:len(words) - k + 1 + j]
    return np.unique(_mix(out))


def set_key(grams: np.ndarray) -> int:
    """One signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        both = _mix(np.array([_mix(grams).sum(dtype=np.uint64) + _U(len(grams)) * _BASE], dtype=np.uint64))
    return int(both.view(np.int64)[0])


def overlap_needed(a, b):
    """Least common shingles of sets of sizes a and b with 100 * common >= 75 * union."""
    return -((-3 * (a + b)) // 7)


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def range_counts(grams: np.ndarray) -> bytes:
    """Shingles in equal ranges of hashes, of which each has 4 to 8 on average (at least 32 ranges)."""
    bits = max(5, len(grams).bit_length() - 3)
    counts = np.bincount((grams >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint16).tobytes() if counts.max() < 1 << 16 else b""


def may_link(a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
    """Whether the range counts allow a link: what they differ by is in one of the sets only."""
    if not a or not b:
        return True
    x, y = np.frombuffer(a, dtype=np.uint16).astype(np.int64), np.frombuffer(b, dtype=np.uint16).astype(np.int64)
    least = min(len(x), len(y))
    x, y = x.reshape(least, -1).sum(axis=1), y.reshape(least, -1).sum(axis=1)
    return int(np.abs(x - y).sum()) <= n_a + n_b - 2 * overlap_needed(n_a, n_b)


def _slots(grams: np.ndarray) -> np.ndarray:
    return ((grams >> _U(8)) % _U(SLOTS)).astype(np.int64)


def _survey(docs: DataFrame) -> DataFrame:
    """One pass over all texts: doc_id, text hash, set key and size of each row; slot and used of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, waiting = np.zeros(SLOTS, dtype=np.int64), []

        def add_up():
            if waiting:
                np.add(used, np.bincount(np.concatenate(waiting), minlength=SLOTS), out=used)
                waiting.clear()

        def batch_of(ids, texts, keys, sizes, slots, uses):
            return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (ids, texts, keys, sizes, slots, uses)],
                                              names=["doc_id", "th", "key", "n", "slot", "used"])

        for batch in batches:
            keys, sizes = [], []
            for text in batch.column("text"):
                grams = shingles(text.as_py())
                keys.append(set_key(grams))
                sizes.append(len(grams))
                waiting.append(_slots(grams))
                if len(waiting) >= 2000:
                    add_up()
            add_up()
            none = [None] * len(keys)
            yield batch_of(batch.column("doc_id").cast(pa.int64()), batch.column("th"), keys, sizes, none, none)
        some = np.flatnonzero(used)
        none = [None] * len(some)
        yield batch_of(none, none, none, none, some, used[some])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(
        run, "doc_id long, th long, key long, n long, slot long, used long")


def _postings(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """gram, key, n, pos of the prefix shingles of all sets."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # SLOTS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, seen = shared.value, set()
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("text"):
                grams = shingles(text.as_py())
                key = set_key(grams)
                if not len(grams) or key in seen:
                    continue
                seen.add(key)
                order = np.lexsort((grams, used[_slots(grams)]))[:prefix_length(len(grams))]
                k = len(order)
                out.append((grams[order].view(np.int64), np.full(k, key, dtype=np.int64),
                            np.full(k, len(grams), dtype=np.int32), np.arange(k, dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                                 names=["gram", "key", "n", "pos"])

    return docs.select("text").mapInArrow(run, "gram long, key long, n int, pos int")


def _lists(postings: DataFrame) -> DataFrame:
    """The postings of shingles with two classes or more: place in the list and a neighbour in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "key", "n", "pos", "rank", "prev", "prev_n"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        held = None  # the last row: whether it has a neighbour is known with the next one

        def rows(cols, linked, where):
            arrays = [pa.array(c[where], type=k) for c, k in zip(cols[:5], kinds[:5], strict=True)]
            arrays += [pa.array(c[where], type=k, mask=~linked[where]) for c, k in zip(cols[5:], kinds[5:], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            g, k, n, p = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "key", "n", "pos"))
            if not len(g):
                continue
            if held is not None:
                g, k, n, p = (np.concatenate([[h], x]).astype(x.dtype) for h, x in zip(held[:4], (g, k, n, p), strict=True))
            fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])  # a class once
            g, k, n, p = g[fresh], k[fresh], n[fresh], p[fresh]
            linked = np.concatenate([[held is not None and held[4]], g[1:] == g[:-1]])
            start = np.maximum.accumulate(np.where(linked, 0, np.arange(len(g))))
            rank = np.arange(len(g)) - start
            if held is not None and held[4]:
                own = np.cumprod(linked).astype(bool)  # still the held row's list
                rank[own] += held[5]
            # neighbour: the first of its size range in the list, or for that one the entry before
            band = np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3)).astype(np.int64)
            opens = np.concatenate([[True], (g[1:] != g[:-1]) | (band[1:] != band[:-1])])
            lead = np.maximum.accumulate(np.where(opens, np.arange(len(g)), 0))
            prev = np.where(opens, np.concatenate([k[:1], k[:-1]]), k[lead])
            prev_n = np.where(opens, np.concatenate([n[:1], n[:-1]]), n[lead])
            lead_key, lead_n = k[lead], n[lead]
            if held is not None:
                same = lead == 0
                lead_key, lead_n = np.where(same, held[8], lead_key), np.where(same, held[9], lead_n)
                prev, prev_n = np.where(same, held[8], prev), np.where(same, held[9], prev_n)
                prev[0], prev_n[0] = held[6], held[7]
            cols = (g, k, n, p, rank, prev, prev_n)
            useful = (linked | np.concatenate([linked[1:], [False]]))
            useful[-1] = False
            if useful.any():
                yield rows(cols, linked, useful)
            held = (g[-1], k[-1], n[-1], p[-1], bool(linked[-1]), int(rank[-1]), int(prev[-1]), int(prev_n[-1]),
                    int(lead_key[-1]), int(lead_n[-1]))
        if held is not None and held[4]:
            cols = tuple(np.array([x]) for x in (*held[:4], held[5], held[6], held[7]))
            yield rows(cols, np.array([True]), np.array([True]))

    return (postings.repartition("gram").sortWithinPartitions("gram", "n", "key")
            .mapInArrow(run, "gram long, key long, n int, pos int, rank long, prev long, prev_n int"))


def _families(lists: DataFrame) -> DataFrame:
    """node and label: classes that are neighbours in enough of their lists."""
    near = (lists.where(F.col("prev").isNotNull() & (4 * F.col("prev_n") >= 3 * F.col("n")))
            .groupBy(F.least("key", "prev").alias("a"), F.greatest("key", "prev").alias("b"))
            .agg(F.count(F.lit(1)).alias("times"), F.min("prev_n").alias("n")))
    return components(near.where(F.col("times") >= FAMILY_SHARE * (F.col("n") / 4 + 1)))


def _cross_pairs(lists: DataFrame, families: DataFrame) -> DataFrame:
    """a and b: pairs of different families that share a list and pass the length and positional filters."""
    told = lists.join(families, F.col("key") == F.col("node"), "left").select(
        "gram", "key", "n", "pos", (F.col("rank") / BLOCK).cast("long").alias("block"),
        F.coalesce("label", "key").alias("family"))
    blocks = lists.groupBy("gram").agg((F.max("rank") / BLOCK).cast("long").alias("last")).where("last > 0")
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("last", F.lit(0))),
                       lambda b: F.struct(F.least("block", b).alias("lo"), F.greatest("block", b).alias("hi")))
    units = (told.join(blocks, "gram", "left")
             .select("gram", "key", "n", "pos", "block", "family", F.inline(each)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "lo", "hi", "block", "key", "n", "pos", "family"]
        rest = None

        def pairs(lists_of: dict, first: np.ndarray, size: np.ndarray):
            found = []
            family, n, pos, key, block = (lists_of[c] for c in ("family", "n", "pos", "key", "block"))
            mixed = np.minimum.reduceat(family, first) != np.maximum.reduceat(family, first)
            for f, s in zip(first[mixed], size[mixed], strict=True):
                u = slice(f, f + s)
                fa, nn, pp, kk, bb = family[u], n[u].astype(np.int64), pos[u].astype(np.int64), key[u], block[u]
                lo, hi = lists_of["lo"][f], lists_of["hi"][f]
                for at in range(1, s):
                    low = np.searchsorted(nn, -(-3 * nn[at] // 4))  # sorted by size
                    if low >= at:
                        continue
                    c = slice(low, at)
                    left = 1 + np.minimum(nn[c] - pp[c], nn[at] - pp[at]) - 1
                    ok = (fa[c] != fa[at]) & (left >= overlap_needed(nn[c], nn[at]))
                    if lo != hi:
                        ok &= bb[c] != bb[at]
                    if ok.any():
                        other = kk[c][ok]
                        found.append(np.stack([np.minimum(other, kk[at]), np.maximum(other, kk[at])], axis=1))
            if not found:
                return None
            both = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        def split(cols: dict):
            g, lo, hi = cols["gram"], cols["lo"], cols["hi"]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            first = np.flatnonzero(new)
            return first, np.diff(np.concatenate([first, [len(g)]]))

        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if not len(cols["gram"]):
                continue
            if rest is not None:
                cols = {c: np.concatenate([rest[c], cols[c]]) for c in names}
            first, size = split(cols)
            if len(first) > 1:
                out = pairs(cols, first[:-1], size[:-1])
                if out is not None:
                    yield out
            rest = {c: x[first[-1]:] for c, x in cols.items()}  # at most two blocks of a list
        if rest is not None:
            out = pairs(rest, *split(rest))
            if out is not None:
                yield out

    return (units.repartition("gram", "lo", "hi").sortWithinPartitions("gram", "lo", "hi", "n", "key")
            .select("gram", "lo", "hi", "block", "key", "n", "pos", "family")
            .mapInArrow(run, "a long, b long").distinct())


def _classes(rows: DataFrame, keys: DataFrame, families: DataFrame) -> DataFrame:
    """Of the classes in ``keys``: one of their rows, their family (label, or null) and its number of parts."""
    told = (rows.join(keys, "key", "left_semi").groupBy("key")
            .agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("n").alias("n"))
            .join(families.withColumnRenamed("node", "key"), "key", "left"))
    parts = (told.where(F.col("label").isNotNull()).groupBy("label").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / FAMILY_DOCS), F.ceil(F.sum("n") / FAMILY_SHINGLES)).cast("long").alias("parts"))
        .withColumnRenamed("label", "of"))
    return told.join(parts, F.col("label") == F.col("of"), "left").select(
        F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"), "label", "parts")


def _sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """key, n, shingles, counts by hash range, label and parts of the given classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # repeated rows come to the same task
        for batch in batches:
            out, at = [], []
            for i, text in enumerate(batch.column("text")):
                grams = shingles(text.as_py())
                key = set_key(grams)
                if key not in seen:
                    seen.add(key)
                    out.append((key, len(grams), grams.tobytes(), range_counts(grams)))
                    at.append(i)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                family = [batch.column(c).take(pa.array(at)) for c in ("label", "parts")]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)),
                                                  *family], names=["key", "n", "grams", "ranges", "label", "parts"])

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return (texts.join(classes, F.expr("doc_id <=> rep_id AND th = rep_th")).select("text", "label", "parts")
            .mapInArrow(run, "key long, n long, grams binary, ranges binary, label long, parts long"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are links: suffix filter by counts in hash ranges, then the whole sets."""

    def near(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series([may_link(*x) for x in zip(a, b, na.tolist(), nb.tolist(), strict=True)], dtype=bool)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the pair's other set, which comes right before
        for batch in batches:
            found = []
            for x, y, grams in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(),
                                   batch.column("grams"), strict=True):
                own = np.frombuffer(grams.as_buffer(), dtype=np.uint64)
                if held is not None and held[:2] == (x, y):
                    common = len(np.intersect1d(held[2], own, assume_unique=True))
                    if common >= overlap_needed(len(held[2]), len(own)):
                        found.append((x, y))
                held = (x, y, own.copy())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*found, strict=True)],
                                                 names=["a", "b"])

    def side(name: str, *cols: str) -> DataFrame:
        return sets.select(F.col("key").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in cols])

    near_udf = F.pandas_udf(near, "boolean")
    close = keep(pairs.join(side("a", "ranges", "n"), "a").join(side("b", "ranges", "n"), "b")
                 .where(near_udf("ranges_a", "ranges_b", "n_a", "n_b")).select("a", "b"), "close-pairs")
    # the sets move once, then each pair's two sets meet
    wanted = close.select("a", "b", F.explode(F.array("a", "b")).alias("key"))
    return (wanted.join(sets.select("key", "grams"), "key").select("a", "b", "grams")
            .repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(linked, "a long, b long"))


def _spanning(keys: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links of a forest with the components of all links between left and right sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, place, times = np.unique(grams, return_inverse=True, return_counts=True)
    many = times[place] > 1
    place, owner = np.unique(place[many], return_inverse=True)[1], owner[many]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    row, col = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    step = 4096
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        a, b = np.searchsorted(place, [low, low + step])
        p, o = place[a:b] - low, owner[a:b]
        x, y = np.zeros((len(left), step), dtype=np.float32), np.zeros((len(right), step), dtype=np.float32)
        x[row[o][row[o] >= 0], p[row[o] >= 0]] = 1
        y[col[o][col[o] >= 0], p[col[o] >= 0]] = 1
        common += x @ y.T
    need = overlap_needed(sizes[left][:, None], sizes[right][None, :])
    link = np.rint(common).astype(np.int64) >= need
    la, lb = np.nonzero(link)
    label = local_labels(len(sets), left[la], right[lb])
    moved = np.flatnonzero(label != np.arange(len(sets)))
    return [(int(keys[i]), int(keys[label[i]])) for i in moved]


def _block_links(units: DataFrame, *block: str) -> DataFrame:
    """Spanning forests of the links between the left and the right sets of each block."""

    def run(table: pa.Table) -> pa.Table:
        keys = table["node"].to_numpy()
        grams = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["grams"]]
        left, right = (np.flatnonzero(table[c].to_numpy(zero_copy_only=False)) for c in ("is_left", "is_right"))
        links = _spanning(keys, grams, left, right)
        return pa.table({"a": pa.array([x for x, _ in links], type=pa.int64()),
                         "b": pa.array([y for _, y in links], type=pa.int64())})

    return units.select(*block, "node", "is_left", "is_right", "grams").groupBy(*block).applyInArrow(run, "a long, b long")


def _family_links(sets: DataFrame) -> DataFrame:
    """Links inside families, as forests.

    A family is dealt into parts of bounded size. Each part is compared all with all, together with
    some pivots (about PIVOTS members, the same in all parts), which tie the parts' components
    together. Only members that are then outside the family's largest component are compared with all
    the others of the family, in blocks.
    """
    yes, no = F.lit(True), F.lit(False)
    family = (sets.where(F.col("label").isNotNull())
              .select("label", F.col("key").alias("node"), "n", "parts", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"), "grams"))
    pivots = (family.where((F.col("parts") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts") * max(1, FAMILY_DOCS // PIVOTS)) == 0))
              .withColumn("own", F.col("part"))
              .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("part <> own").drop("own"))
    units = family.unionByName(pivots).withColumns({"is_left": yes, "is_right": yes})
    links = _block_links(units, "label", "part")
    if not family.where("parts > 1").limit(1).count():
        return links
    links = keep(links, "part-links")
    large = family.where("parts > 1").select("label", "node", "n", "parts", "part")
    found = components(links).select(F.col("node").alias("of"), F.col("label").alias("comp"))
    members = keep(large.join(found, F.col("node") == F.col("of"), "left")
                   .select("label", "node", "n", "parts", F.coalesce("comp", "node").alias("comp")), "family-members")
    main = (members.groupBy("label", "comp").agg(F.count(F.lit(1)).alias("size"))
            .groupBy("label").agg(F.max(F.struct("size", "comp")).alias("main")).select("label", "main.comp"))
    open_ = keep(members.join(main, ["label", "comp"], "left_anti").select("label", "node", "n"), "open-members")
    blocks = (open_.groupBy("label").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / FAMILY_DOCS), F.ceil(F.sum("n") / FAMILY_SHINGLES)).cast("long").alias("blocks")))

    def each(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    rest = family.join(blocks, "label")
    left = (rest.join(open_.select("node"), "node", "left_semi").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
            .withColumn("part", each("parts")).withColumns({"is_left": yes, "is_right": no}))
    right = rest.withColumn("block", each("blocks")).withColumns({"is_left": no, "is_right": yes})
    return links.unionByName(_block_links(left.unionByName(right), "label", "block", "part"))


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, number of shingles and component label (null without words) of every row."""
    docs = docs.select("doc_id", "text")
    survey = keep(_survey(docs), "shingle-sets")
    uses = survey.where(F.col("slot").isNotNull()).groupBy("slot").agg(F.sum("used").alias("used")).toArrow()
    counts = np.zeros(SLOTS, dtype=np.int64)
    counts[uses["slot"].to_numpy()] = uses["used"].to_numpy()
    rows = survey.where(F.col("slot").isNull()).select("doc_id", "th", "key", "n")

    lists = keep(_lists(_postings(docs, counts)), "posting-lists")
    families = keep(_families(lists), "families")
    pairs = keep(_cross_pairs(lists, families), "cross-pairs")
    needed = (families.select(F.col("node").alias("key"))
              .unionByName(pairs.select(F.col("a").alias("key"))).unionByName(pairs.select(F.col("b").alias("key")))
              .distinct())
    sets = keep(_sets(docs, _classes(rows, needed, families)), "needed-sets")
    links = _family_links(sets).unionByName(_verified(pairs, sets))
    found = components(links)

    named = rows.join(found, F.col("key") == F.col("node"), "left").select(
        "doc_id", "th", "n", F.when(F.col("n") > 0, F.coalesce("label", "key")).alias("label"))
    return keep(named, "named-rows")


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    named = _labelled(docs)
    # written before the join: Spark can then split the rows of a hot label
    smallest = keep(named.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("smallest"))
                    .withColumnRenamed("label", "of"), "smallest-ids")
    return named.join(smallest, F.col("label") == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with its own columns, and every row without words.

    It is the row with the smallest doc_id (null after all others), then text hash; of rows equal in
    both, any one.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("_id"), F.col("th").alias("_th"),
                    F.col("copies").alias("_copies"))
    chosen = keep(_labelled(docs).where(F.col("label").isNotNull())
                  .groupBy("label", "doc_id", "th").agg(F.count(F.lit(1)).alias("copies"))
                  .groupBy("label").agg(F.min(rank).alias("rank")).select("rank._id", "rank._th", "rank._copies"),
                  "chosen-rows")
    same = F.expr("doc_id <=> _id AND xxhash64(text) = _th")
    # rows equal in both are added up before they move: they may be very many
    repeated = (docs.join(chosen.where("_copies > 1"), same).groupBy("_id", "_th")
                .agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*"))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return (docs.where(words).join(chosen.where("_copies = 1"), same, "left_semi")
            .unionByName(repeated).unionByName(docs.where(~words)))
