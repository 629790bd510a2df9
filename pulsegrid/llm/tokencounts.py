"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A text is cut at safe places (see :mod:`bytepairs`) into leaves of some hundred characters; the tree
keeps characters and tokens of every subtree. An edit finds its leaves by the character sums, joins
them with its replacement and, where the edit touches the seam to a neighbour, with that neighbour
as boundary context; only this region is encoded again, and the sums on its path change.

Defined results: null and empty texts have 0 tokens; edits without overlap may come in any order;
an edit that begins inside an earlier one is refused by ValueError; repeated rows are counted one by
one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from .bytepairs import encoder, next_cut

LEAF_CHARS = 256

#: Personal data that the registered query masks: pattern and replacement.
MASKS = (
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "<EMAIL>"),
    (re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])"), "<IP>"),
    (re.compile(r"(?<!\w)\+?\d[\d ().-]{7,}\d(?!\w)"), "<NUMBER>"),
)

Edit = tuple[int, int, str]  # start, end, replacement


class CountTree:
    """Leaves hold text; inner nodes hold the characters and tokens below them."""

    def __init__(self, text: str, count: Callable[[str], int], leaf_chars: int = LEAF_CHARS):
        self._count = count
        self.leaves: list[str] = []
        at = 0
        while at < len(text):
            end = next_cut(text, at + leaf_chars)
            self.leaves.append(text[at:end])
            at = end
        self._width = 1 << max(0, len(self.leaves) - 1).bit_length()
        self._chars = [0] * (2 * self._width)
        self._tokens = [0] * (2 * self._width)
        for k, leaf in enumerate(self.leaves):
            self._chars[self._width + k], self._tokens[self._width + k] = len(leaf), count(leaf)
        for node in range(self._width - 1, 0, -1):
            self._sum(node)
        self.encoded = 0  # characters encoded again by edits

    def _sum(self, node: int) -> None:
        self._chars[node] = self._chars[2 * node] + self._chars[2 * node + 1]
        self._tokens[node] = self._tokens[2 * node] + self._tokens[2 * node + 1]

    @property
    def tokens(self) -> int:
        return self._tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        node, start = 1, 0
        while node < self._width:
            node *= 2
            if at >= start + self._chars[node]:
                start += self._chars[node]
                node += 1
        return node - self._width, start

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self._width + leaf
        self._chars[node], self._tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            self._sum(node)

    def replace(self, start: int, end: int, replacement: str) -> None:
        """Puts the replacement in place of the characters from start to end."""
        if not self.leaves:
            self.leaves = [""]
        total = self._chars[1]
        first, begin = self._leaf_at(min(start, max(0, total - 1))) if total else (0, 0)
        last, last_begin = self._leaf_at(min(max(start, end - 1), max(0, total - 1))) if total else (0, 0)
        before = self.leaves[first][:start - begin]
        after = self.leaves[last][end - last_begin:]
        region = before + replacement + after
        while first > 0 and not _safe(self.leaves[first - 1], region):
            first -= 1
            region = self.leaves[first] + region
        while last + 1 < len(self.leaves) and not _safe(region, self.leaves[last + 1]):
            last += 1
            region += self.leaves[last]
        self.encoded += len(region)
        self._set(first, region, self._count(region))
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, "", 0)


def _safe(left: str, right: str) -> bool:
    """Whether two neighbouring parts may be encoded apart."""
    return bool(left) and len(right) > 1 and right[0] == " " and not left[-1].isspace() and not right[1].isspace()


def masks(text: str) -> list[Edit]:
    """Personal data in a text as edits: the first pattern that fits a place wins."""
    found: list[Edit] = []
    for pattern, replacement in MASKS:
        for m in pattern.finditer(text):
            if all(m.end() <= s or m.start() >= e for s, e, _ in found):
                found.append((m.start(), m.end(), replacement))
    return sorted(found)


def count_edited(text: str | None, edits: Sequence[Edit], count: Callable[[str], int]) -> tuple[int, int, int]:
    """Tokens before and after the edits, and the characters that were encoded again."""
    tree = CountTree(text or "", count)
    before, limit = tree.tokens, None
    for start, end, replacement in sorted(edits, reverse=True):  # from the end: places stay valid
        if not 0 <= start <= end or (limit is not None and end > limit):
            raise ValueError("edits overlap")
        tree.replace(start, end, replacement)
        limit = start
    return before, tree.tokens, tree.encoded


def token_counts(docs: DataFrame, edits: Callable[[str], list[Edit]] = masks, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited and chars_reencoded of each document."""
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "chars_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary).count
        for batch in batches:
            rows: list[list[int]] = [[], [], [], []]
            for value in batch.column("text"):
                text = value.as_py() or ""
                found = edits(text)
                before, after, encoded = count_edited(text, found, count)
                for column, x in zip(rows, (before, len(found), after, encoded), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()),
                                              *(pa.array(c, type=pa.int64()) for c in rows)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))
