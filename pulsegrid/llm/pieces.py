"""SentencePiece (BPE with byte fallback) by a table of prefix ends, and its decoding.

For every prefix of a segment the encoding ends in exactly one token. The table of these last tokens
is filled from left to right: an Aho-Corasick automaton gives the vocabulary's tokens that end at a
position, and the one is stored that fits the last token of the prefix before it, that is, whose
pair with it would stay two tokens. The ids are then read off backwards from the end of the table.

A pair stays apart if no merge across its seam would have come first: the two tokens are taken
apart again in reverse order of their merges, and at each step the two parts that touch at the seam
must have no common piece that ranks before the merges already undone.

Segments: no piece of the vocabulary has the white space mark behind another character and none has
a line feed, so a text falls into words with one mark in front, runs of further marks, and line
feeds; words are encoded apart and remembered. The merges of marks alone rank behind all others and
equal each other, so they come last and from the left: a run is as long as its word leaves it.

Defined results: null counts as the empty text (begin and end ids only); repeated rows are encoded
one by one; an empty table gives no rows; other columns than the two named are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CACHE_SEGMENTS = 300_000  # words remembered by one worker in each of two generations
CACHE_CHARS = 48          # longer words are encoded each time
CACHE_PAIRS = 1_500_000

_SEGMENTS = re.compile(f"\n|{MARK}{MARK}+[^{MARK}\n]*|{MARK}?[^{MARK}\n]+|{MARK}").findall


class PieceCodec:
    """Encoder and decoder of one worker process; see :func:`codec`."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        self._byte_ids = [0] * 256
        self._unstripped = special | {self.unk}  # ids whose text keeps a space in front
        self._shown: list[bytes | int] = [b""] * size  # a piece's text; of a byte piece, the byte
        texts: dict[str, int] = {}
        scores: dict[int, float] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self._byte_ids[int(piece[3:5], 16)] = i
                byte = int(piece[3:5], 16)
                self._shown[i] = byte if byte > 0x7F else bytes([byte])  # one below is always a character
                self._unstripped.add(i)
            elif i == self.unk:
                self._shown[i] = " ⁇ ".encode()
            elif i not in special:
                self._shown[i] = piece.replace(MARK, " ").encode()
                texts[piece] = i
                scores[i] = model.get_score(i)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in texts):
            raise ValueError("a piece has the white space mark behind another character, or a line feed")
        # rank of a merge: the better score first
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self._rank = {t: order[scores[t]] for t in texts.values()}
        self._ids, self._text = texts, {i: p for p, i in texts.items()}
        self._runs = {len(p): i for p, i in texts.items() if set(p) == {MARK}}
        self._run_bytes: dict[int, bytes] = {}
        if len({self._rank[i] for n, i in self._runs.items() if n > 1} | {max(order.values())}) > 1:
            raise ValueError("merges of marks don't rank last")
        self._halves: dict[int, tuple[int, int]] = {}
        self._apart: dict[int, bool] = {}
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._automaton = self._build(texts)
        self._begin, self._end, self._mark = (array("I", [i]).tobytes() for i in (self.bos, self.eos, self._runs[1]))

    def _build(self, texts: dict[str, int]):
        """Tokens that stand for themselves when encoded, with the halves of their last merge."""
        auto = ahocorasick.Automaton()
        for piece, i in sorted(texts.items(), key=lambda x: len(x[0])):
            if len(piece) > 1:
                parts = self._merge(piece)
                if parts is None:
                    continue
                self._halves[i] = parts
            auto.add_word(piece, i << 16 | len(piece))
        auto.make_automaton()
        return auto

    def _merge(self, piece: str) -> tuple[int, int] | None:
        """Merges the characters of a piece in order of rank; the last two parts, or None if it never forms."""
        parts = list(piece)
        while len(parts) > 2:
            best, at = None, 0
            for k in range(len(parts) - 1):
                made = self._ids.get(parts[k] + parts[k + 1])
                if made is not None and (best is None or self._rank[made] < best):
                    best, at = self._rank[made], k
            if best is None:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        left, right = (self._ids.get(p) for p in parts)
        return None if left is None or right is None else (left, right)

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' texts together is the two tokens."""
        rank, halves, ids, text = self._rank, self._halves, self._ids, self._text
        undone_left = undone_right = 1 << 30  # rank of the merge that consumed the part at the seam
        while True:
            made = ids.get(text[left] + text[right])
            # of equal ranks the merge further left comes first
            if made is not None and rank[made] < undone_left and rank[made] <= undone_right:
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and rank[left] >= rank[right]):
                undone_left, left = rank[left], a[1]
            else:
                undone_right, right = rank[right], b[0]

    def _word(self, word: str) -> bytes:
        """Packed ids of a text with one mark at most, in front; foreign characters as their bytes."""
        n = len(word)
        last = [-1] * (n + 1)  # token at the end of each prefix; -1: a character outside the vocabulary
        length = [1] * (n + 1)
        apart = self._apart
        for end, found in self._automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue  # matches of one end come longest first, and only one fits
            size = found & 0xFFFF
            before = last[end - size] if end > size else -1
            if before >= 0:
                pair = before << 36 | found
                fits = apart.get(pair)
                if fits is None:
                    if len(apart) >= CACHE_PAIRS:
                        apart.clear()
                    fits = apart[pair] = self._stays_apart(before, found >> 16)
                if not fits:
                    continue
            last[end], length[end] = found >> 16, size
        out, at = array("I"), n
        while at:
            token = last[at]
            if token >= 0:
                out.append(token)
            else:
                out.extend(self._byte_ids[b] for b in reversed(word[at - 1].encode()))
            at -= length[at]
        out.reverse()
        return out.tobytes()

    def _run(self, marks: int) -> bytes:
        """Packed ids of marks alone: merged from the left as far as the vocabulary has the length."""
        known = self._run_bytes.get(marks)
        if known is None:
            lengths: list[int] = []
            for _ in range(marks):
                lengths.append(1)
                while len(lengths) > 1 and lengths[-2] + lengths[-1] in self._runs:
                    lengths[-2:] = [lengths[-2] + lengths[-1]]
            known = array("I", [self._runs[x] for x in lengths]).tobytes()
            if marks <= CACHE_CHARS:
                self._run_bytes[marks] = known
        return known

    def _fresh(self, segment: str) -> bytes:
        """Ids of a segment that isn't in the newer generation."""
        ids = self._old.get(segment)
        if ids is None:
            word = segment.lstrip(MARK)
            marks = len(segment) - len(word)
            if marks < 2:
                ids = self._word(segment)
            elif not word:
                ids = self._run(marks)
            else:
                ids = self._word(MARK + word)
                if ids[:4] == self._mark:
                    ids = self._run(marks) + ids[4:]
                else:
                    ids = self._run(marks - 1) + ids
        if len(segment) <= CACHE_CHARS:
            if len(self._new) >= CACHE_SEGMENTS:
                self._old, self._new = self._new, {}
            self._new[segment] = ids
        return ids

    def packed(self, text: str | None) -> bytes:
        """All ids with begin and end, as little-endian unsigned 32-bit integers."""
        parts = [self._begin]
        if text:
            for segment in _SEGMENTS(MARK + text.replace(" ", MARK)):
                parts.append(self._new.get(segment) or self._fresh(segment))
        parts.append(self._end)
        return b"".join(parts)

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    def decoded(self, ids: list[int]) -> bytes:
        """Text of the ids in UTF-8: marks become spaces, without the one that encoding puts in front.

        Runs of byte pieces are read as UTF-8; each byte that is no part of a character becomes U+FFFD.
        """
        shown = list(map(self._shown.__getitem__, ids))
        first = next((k for k, x in enumerate(shown) if x != b""), None)
        if first is not None and ids[first] not in self._unstripped:
            shown[first] = shown[first].removeprefix(b" ")
        try:
            return b"".join(shown)
        except TypeError:  # bytes that are only characters together
            out, run = [], bytearray()
            for x in [*shown, b""]:
                if type(x) is int:
                    run.append(x)
                    continue
                if run:
                    out.append(_utf8(bytes(run)))
                    run.clear()
                out.append(x)
            return b"".join(out)


def _utf8(run: bytes) -> bytes:
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        out, at = bytearray(), 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    run[at:at + size].decode()
                except UnicodeDecodeError:
                    continue
                out += run[at:at + size]
                at += size
                break
            else:
                out += "�".encode()
                at += 1
        return bytes(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str | None = None) -> PieceCodec:
    """The worker's codec for a model file (by default the public one), built once."""
    path = path or public_tokenizers.path(MODEL)
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ``ids`` (little-endian unsigned 32-bit integers) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            ids = [c.packed(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, type=pa.binary())],
                                             names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """The encoded rows with ``decoded``, the text of their ids in UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            texts = [c.decoded(np.frombuffer(i.as_buffer(), dtype="<u4").tolist()) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"),
                                              pa.array(texts, type=pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the text decoded from them, without moving either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column("text"):
                packed = c.packed(text.as_py())
                n.append(len(packed) >> 2)
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_text.append(hashlib.sha256(c.decoded(array("I", packed).tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, type=pa.int64()), pa.array(of_ids, type=pa.string()),
                 pa.array(of_text, type=pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
