"""HTML extraction: page structure, and the repeated token runs of each host's pages.

A page becomes blocks of text. Markup gives each a kind: scripts, styles and the like hold no text;
menus, headers, footers, sidebars, notices, adverts, forms and reader comments (by element, role,
class or id) are template blocks; headings, paragraphs, quotations, lists and tables inside the
article are its text. Open are other blocks of the article, and all blocks of a page without an
article or main element.

The token streams of all blocks of all pages enter the suffixes of their host, whatever their kind.
Two suffixes that agree in DEPTH tokens (a shorter block: in all of it) are neighbours in suffix
order with such a common prefix, and every token of a repeated run of DEPTH tokens or more lies in
such a prefix. So a suffix is told by its first DEPTH tokens, its head, and of each head the pages
are counted that hold it as article text and in other blocks. A token is covered, and goes, if a
head over it

* in an open block is on two pages or more outside of article text, and on more than as such;
* in article text is on more than half of the pages of a host with CROWD pages or more.

Template blocks are counted and never kept. The unique runs between covered tokens stay.

Pages are written once, in pieces of about PIECE tokens, each under a label of its own in a table
with one bucket a scan task. A piece sends the hash of each of its heads once, 38 bits and whether
it is on one, two or more of its pages. Heads that may cover something go back to their pieces,
which send them with 128 bits, page and kind to be counted exactly; the verdicts go back the same
way, and the texts never move. A menu on all pages of a host with a third of all pages is one
hash a piece in the first step and one row a page in the second, dealt by page.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by one line feed; nothing else is dropped or cut.

Defined results: null and empty html give an empty text; pages without a host form one host; equal
rows are one page and get the same text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import checkpoint_dir

from . import wordhash
from .anchors import BUCKET, MOST_BUCKETS, labels, pack_sorted, split, squeeze, unpack_sorted, unsqueeze
from .common import drop, keep, spread
from .urlfilter import split_url

DEPTH = 8
CROWD = 10           # pages of a host from which article text can be told to be on most of them
BITS = 38            # of a head's hash in the first step
PIECE = 1 << 20      # tokens of the pages that a worker holds, about

_U = np.uint64

TEXT, OPEN, TEMPLATE = 2, 1, 0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^a-z0-9]+")

#: Names of the HTML standard.
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_SILENT = frozenset("head template svg math canvas object audio video noscript select datalist map".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption summary".split())
_TEMPLATE = frozenset("nav footer aside form menu dialog search button fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar "
                   "toolbar tablist".split())
#: Words of a class or id that mark template blocks.
_MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead topbar ad ads adv advert adverts "
    "advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments disqus respond reply replies pagination pager toolbar widget "
    "widgets search skip".split())
_WEAK = frozenset(["header"])
_OWN = frozenset("article post entry content main story text title".split())
_ASIDE_ARTICLES = frozenset("comment comments reply ad ads advert promo sponsored related teaser".split())


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if source else {}


def _is_template(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    if name in _TEMPLATE or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" \
            or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    words = set(_WORD.split(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
    if name in ("article", "main"):
        return bool(words & _ASIDE_ARTICLES)
    if attributes.get("role", "").lower() in _ROLES or words & _MARKS:
        return True
    return bool(words & _WEAK) and not in_article and not words & _OWN


def blocks(page: str | None) -> list[tuple[int, str]]:
    """Kind and text of the blocks of a page, in page order."""
    found: list[tuple[int, bool, bool, str]] = []  # scope, template, prose, text
    stack: list[tuple[str, bool, int, bool, bool]] = [("", False, 0, False, False)]  # name, template, scope, prose, silent
    parts: list[str] = []
    page = page or ""

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, template, scope, prose, _ = stack[-1]
                found.append((scope, template, prose, text))
            parts.clear()

    def close(name: str):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                flush()
                del stack[k:]
                return

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            if not m[0].startswith(("<!", "<?")) and not stack[-1][4]:
                parts.append(m[0])
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            if name in _BLOCK:
                if any(s[0] == name for s in stack):
                    close(name)
                else:
                    flush()
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        if stack[k][1] != stack[k - 1][1] or stack[k][4]:
                            flush()
                        del stack[k:]
                        break
                    if stack[k][0] in _BLOCK:
                        break
            continue
        source = m["attributes"] or m["attributes2"] or ""
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            if name == "textarea":
                flush()
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            elif name == "br":
                parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
            if name not in ("option", "legend", "summary"):
                for k in range(len(stack) - 1, 0, -1):  # an open paragraph ends here
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in _BLOCK:
                        break
            if name in ("li", "dd", "dt", "tr", "td", "th"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "menu", "article", "section", "div"):
                        break
        if source.rstrip().endswith("/") and name in ("svg", "path", "use"):
            continue
        _, template, scope, prose, silent = stack[-1]
        mine = _is_template(name, _attributes(source), scope == 2)
        if mine and not template:
            flush()
        if not mine:
            scope = 2 if name == "article" else max(scope, 1) if name == "main" else scope
        if name in _SILENT and not silent:
            flush()
        stack.append((name, template or mine, scope, prose or name in _PROSE, silent or name in _SILENT))
    flush()

    best = max((scope for scope, template, _, _ in found if not template), default=0)
    return [(TEMPLATE if template or scope < best else TEXT if prose and best else OPEN, text)
            for scope, template, prose, text in found]


class _Pages:
    """The parsed pages as one table, in buckets by the label of their piece, ``_task``."""

    def __init__(self, pages: DataFrame):
        spark = pages.sparkSession
        tasks = max(1, spread(pages))
        buckets = min(tasks, MOST_BUCKETS)
        pieces = spark.sparkContext.broadcast(labels(spark, tasks, buckets))
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, cost = TaskContext.get().partitionId(), 0
            own = np.array(pieces.value[part % len(pieces.value)])
            for batch in batches:
                found = [blocks(p.as_py()) for p in batch.column("html")]
                ends = cost + np.cumsum([sum(len(t) // 8 + 8 for _, t in page) + 8 for page in found], dtype=np.int64)
                piece, cost = np.append(cost, ends[:-1]) // PIECE % len(own), int(ends[-1]) if len(ends) else cost
                out = pa.array([[{"kind": k, "text": t} for k, t in page] for page in found], type=kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").cast(pa.int64()), *(batch.column(c) for c in ("url", "host", "row")),
                     pa.array(own[piece[:len(found)]]), out], names=["page_id", "url", "host", "row", "_task", "blocks"])

        name = f"page_blocks_{uuid.uuid4().hex}"
        (split_url(pages.select("page_id", "url", "html"))
         .select("page_id", "url", F.xxhash64("host").alias("host"), F.xxhash64("page_id", "url", "html").alias("row"), "html")
         .mapInArrow(run, "page_id long, url string, host long, row long, _task long, blocks array<struct<kind:int,text:string>>")
         .write.bucketBy(buckets, "_task").option("path", f"{checkpoint_dir(spark)}/{name}").option("compression", "zstd")
         .format("parquet").saveAsTable(name))
        self.table = spark.table(name)

    def meet(self, notes: DataFrame, work, schema) -> DataFrame:
        """``work`` on each piece's pages and the notes with its label."""
        return self.table.groupBy("_task").cogroup(notes.groupBy("_task")).applyInArrow(work, schema)


class _Heads:
    """The heads of a piece's blocks: two hashes, page, kind, first token and length of each."""

    def __init__(self, table: pa.Table, depth: int):
        lists = table["blocks"].combine_chunks()
        each = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        self.text, kind = flat.field("text"), flat.field("kind").to_numpy()
        self.page = np.repeat(np.arange(len(each)), each)  # of each block
        words = list(wordhash.words_of(self.text))
        self.counts = np.concatenate([w.counts for w in words]) if words else np.zeros(0, dtype=np.int64)
        self.kind, one, two, at, block, base = kind, [], [], [], [], 0
        host = table["host"].to_numpy().view(np.uint64)[self.page]
        for w in words:
            again = wordhash.Words(w.low, w.high, wordhash.mix(w.hashes ^ _U(wordhash.STEP)), w.counts)
            row, last = w.row, w.left == w.counts[w.row - w.low]  # last: the first token of its block
            whole = w.left >= depth
            short = last & ~whole  # the head of a shorter block is all of it
            for out, x, salt in ((one, w, 3), (two, again, 5)):
                head = wordhash.rolling(x.hashes, depth)
                head[short] = wordhash.row_digests(x, salt)[row[short] - w.low]
                out.append(wordhash.mix(head ^ host[row])[whole | short])
            at.append(base + np.flatnonzero(whole | short))
            block.append(row[whole | short])
            base += len(w.hashes)
        none = np.zeros(0, dtype=np.int64)
        self.one, self.two = (np.concatenate(x) if x else none.view(np.uint64) for x in (one, two))
        self.at, self.block = (np.concatenate(x) if x else none for x in (at, block))
        self.length = np.minimum(self.counts[self.block], depth)


def _sent(depth: int, bits: int):
    """The heads of a piece: each hash once, whether in an open block, and its pages: 1, 2, 3 for more."""

    def work(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"_bucket": [], "_task": [], "_data": []}
        heads, label = _Heads(table, depth), table["_task"][0].as_py()
        order = np.lexsort((heads.block, heads.one))
        found, block = heads.one[order] >> _U(64 - BITS), heads.block[order]
        page, is_open = table["row"].to_numpy()[heads.page[block]], heads.kind[block] == OPEN
        if len(found):
            first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            fresh = np.append(True, (found[1:] != found[:-1]) | (page[1:] != page[:-1]))
            pages = np.minimum(np.add.reduceat(fresh.astype(np.int64), first), 3).astype(np.uint64)
            values = found[first] << _U(3) | np.maximum.reduceat(is_open, first).astype(np.uint64) << _U(2) | pages
            for bucket, part in split(values, bits, BITS + 3):
                out["_bucket"].append(bucket)
                out["_task"].append(label)
                steps = pack_sorted(values[part] - (_U(bucket) << _U(BITS + 3 - bits)))
                out["_data"].append(squeeze(np.frombuffer(steps, dtype=np.uint32)))
        return pa.table(out, schema=pa.schema([("_bucket", pa.int32()), ("_task", pa.int64()), ("_data", pa.binary())]))

    return work, "_bucket int, _task long, _data binary"


def _candidates(bits: int):
    """For each piece its heads that may cover tokens, in one bucket of hashes."""
    crowd = CROWD // 2 + 1

    def work(table: pa.Table) -> pa.Table:
        tasks, width = table["_task"].to_pylist(), BITS - bits
        room = (len(tasks) - 1).bit_length()  # of a sender's number, below the hash and its three bits
        assert width + 3 + room <= 64, "too many senders in a bucket"
        keys = [unpack_sorted(unsqueeze(x.as_buffer(), np.uint32)[0]) << _U(room) | _U(k) for k, x in enumerate(table["_data"])]
        keys = np.concatenate(keys)
        keys.sort()
        same = keys[1:] >> _U(room + 3) == keys[:-1] >> _U(room + 3)
        left = (keys >> _U(room)).astype(np.uint8) & 3 >= 2
        left[1:] |= same
        left[:-1] |= same
        keys = keys[left]
        first = np.flatnonzero(np.append(len(keys) > 0, keys[1:] >> _U(room + 3) != keys[:-1] >> _U(room + 3)))
        told = []
        if len(first):
            flags = (keys >> _U(room)).astype(np.uint8) & 7
            pages, is_open = np.add.reduceat(flags & 3, first, dtype=np.int64), np.maximum.reduceat(flags, first) >= 4
            hit = (is_open & (pages >= 2)) | (pages >= crowd) | (np.maximum.reduceat(flags & 3, first) == 3)
            keys = keys[np.repeat(hit, np.diff(np.append(first, len(keys))))]
            keys = (keys & _U((1 << room) - 1)) << _U(width) | keys >> _U(room + 3)  # by sender, then hash
            keys.sort()
            cut = np.searchsorted(keys, np.arange(len(tasks) + 1, dtype=np.uint64) << _U(width)).tolist()
            base = _U(table["_bucket"][0].as_py()) << _U(width)
            told = [(t, pack_sorted((keys[a:b] & _U((1 << width) - 1)) + base))
                    for t, a, b in zip(tasks, cut[:-1], cut[1:], strict=True) if b > a]
        return pa.table({"_task": pa.array([t for t, _ in told], type=pa.int64()),
                         "_data": pa.array([d for _, d in told], type=pa.binary())})

    return work, "_task long, _data binary"


def _shown(depth: int):
    """The candidates of a piece: each head once a page and kind."""
    kinds = pa.schema([("_task", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("host", pa.int64()),
                       ("row", pa.int64()), ("kind", pa.int8())])

    def work(table: pa.Table, notes: pa.Table) -> pa.Table:
        if not notes.num_rows:
            return kinds.empty_table()
        heads = _Heads(table, depth)
        hits = np.unique(np.concatenate([unpack_sorted(x.as_buffer()) for x in notes["_data"]]))
        short = heads.one >> _U(64 - BITS)
        mine = hits[np.minimum(np.searchsorted(hits, short), len(hits) - 1)] == short
        block = heads.block[mine]
        page = heads.page[block]
        columns = [heads.one[mine].view(np.int64), heads.two[mine].view(np.int64), table["host"].to_numpy()[page],
                   table["row"].to_numpy()[page], heads.kind[block].astype(np.int8)]
        order = np.lexsort(columns)
        columns = [c[order] for c in columns]
        fresh = np.append(len(order) > 0, np.any([c[1:] != c[:-1] for c in columns], axis=0))[:len(order)]
        label = np.full(int(fresh.sum()), table["_task"][0].as_py(), dtype=np.int64)
        return pa.table([label, *(c[fresh] for c in columns)], schema=kinds)

    return work, "_task long, h1 long, h2 long, host long, row long, kind byte"


def boilerplate(pages: _Pages, depth: int = DEPTH) -> DataFrame:
    """_task, h1, h2 and kind of the heads that cover tokens in blocks of that kind."""
    spark = pages.table.sparkSession
    tokens = F.expr("aggregate(blocks, 0L, (n, b) -> n + length(b.text) div 6 + 1)")  # about
    total = pages.table.agg(F.coalesce(F.sum(tokens), F.lit(0))).first()[0]
    bits = (max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET, 1) - 1).bit_length()
    work, schema = _sent(depth, bits)
    sent = pages.table.groupBy("_task").applyInArrow(work, schema)
    work, schema = _candidates(bits)
    candidates = sent.groupBy("_bucket").applyInArrow(work, schema)
    work, schema = _shown(depth)
    shown = keep(pages.meet(candidates, work, schema), "page-heads")

    hosts = pages.table.select("host", "row").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    as_text = F.col("kind") == TEXT
    votes = (shown.groupBy("h1", "h2", "host", "row")
             .agg(F.max(as_text.cast("int")).alias("as_text"), F.max((~as_text).cast("int")).alias("other"))
             .groupBy("h1", "h2", "host").agg(F.count(F.lit(1)).alias("n"), F.sum("as_text").alias("n_text"),
                                              F.sum("other").alias("n_other")))
    verdicts = (votes.join(hosts, "host").select(
        "h1", "h2", "host", ((F.col("n_other") >= 2) & (F.col("n_other") > F.col("n_text"))).alias("open_goes"),
        ((2 * F.col("n") > F.col("all")) & (F.col("all") >= CROWD)).alias("text_goes"))
        .where("open_goes or text_goes"))
    goes = ((F.col("kind") == OPEN) & F.col("open_goes")) | (as_text & F.col("text_goes"))
    covering = keep(shown.join(verdicts, ["h1", "h2", "host"]).where(goes).select("_task", "h1", "h2", "kind").distinct(),
                    "page-covering")
    drop(shown)
    return covering


def _rest(depth: int):
    """The pages of a piece with their text."""
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def work(table: pa.Table, notes: pa.Table) -> pa.Table:
        left: dict[int, str] = {}
        if notes.num_rows:
            heads = _Heads(table, depth)
            told = [notes[c].to_numpy() for c in ("h1", "h2", "kind")]
            gone = np.zeros(len(heads.one), dtype=bool)
            for kind in (OPEN, TEXT):
                some = told[2] == kind
                pairs = np.stack([told[0][some], told[1][some]], axis=1).view([("a", "i8"), ("b", "i8")]).ravel()
                mine = np.flatnonzero(heads.kind[heads.block] == kind)
                own = np.stack([heads.one[mine], heads.two[mine]], axis=1).view([("a", "i8"), ("b", "i8")]).ravel()
                gone[mine] = np.isin(own, pairs)
            steps = np.zeros(int(heads.counts.sum()) + 1, dtype=np.int64)
            np.add.at(steps, heads.at[gone], 1)
            np.add.at(steps, heads.at[gone] + heads.length[gone], -1)
            stays, begin = np.cumsum(steps) == 0, np.cumsum(heads.counts) - heads.counts
            for block in np.unique(heads.block[gone]).tolist():
                words = heads.text[block].as_py().split(" ")
                kept = stays[begin[block]:begin[block] + len(words)].tolist()
                left[block] = " ".join(w for w, stay in zip(words, kept, strict=True) if stay)
        texts, n = [], 0
        for page in table["blocks"]:
            parts = []
            for b in page.as_py():
                if b["kind"] != TEMPLATE:
                    parts.append(left.get(n, b["text"]))
                n += 1
            texts.append("\n".join(p for p in parts if p))
        return pa.table([table["page_id"], table["url"], pa.array(texts, type=pa.string()),
                         pa.array([len(t) for t in texts], type=pa.int64())], schema=kinds)

    return work, "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    known = _Pages(pages)
    work, schema = _rest(depth)
    return known.meet(boilerplate(known, depth), work, schema)
