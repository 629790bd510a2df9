"""Packing, SentencePiece and edit-aware counts against the libraries themselves."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsegrid.llm import packing, pieces, tokencounts
from pulsegrid.llm.bytepairs import encoder

from .conftest import LONG, hard_rows

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BPE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
BPE.encode_special_tokens = True
TEXT = st.text(alphabet=st.one_of(st.sampled_from("  \n\taeiorstlndABC0123.,'▁é漢😀"), st.characters(codec="utf-8")), max_size=60)


def bpe(text):
    return BPE.encode(text or "", add_special_tokens=False).ids


def check_pieces(rows, docs, window=2048):
    stream = {}
    for p in rows:
        stream.setdefault(p.sequence_id, []).append(p)
    for seq, ps in stream.items():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1]]
        assert sum(p.length for p in ps) == window or seq == max(stream)
    by_doc = {}
    for p in rows:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    want = {}
    for doc_id, text, *_ in docs:
        ids = [*bpe(text), 1]
        want.setdefault((doc_id, len(ids)), []).append(ids)
    assert {k: sum(p.length for p in v) for k, v in by_doc.items()} == {k: sum(map(len, v)) for k, v in want.items()}
    for k, v in by_doc.items():
        ids = want[k][0]
        assert {packing.crc32(ids[p.start:p.start + p.length]) for p in v} == {p.ids_crc32 for p in v}


def test_packing_hard_rows(spark, hard, empty, clashing):
    rows = packing.piece_digests(packing.pack(hard)).collect()
    check_pieces(rows, hard_rows())
    assert packing.pack(empty).count() == 0
    check_pieces(packing.piece_digests(packing.pack(clashing, window=64)).collect(), hard_rows(), 64)


def test_packing_keeps_the_ids(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * i) for i in range(50)], "doc_id long, text string")
    ids = {}
    for p in packing.pack(docs, window=100).orderBy("doc_id", "start").collect():
        ids.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, dtype="<u4").tolist())
    assert ids == {i: [*bpe(f"text number {i} " * i), 1] for i in range(50)}


def test_byte_pairs_equal_the_tokenizer(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text in texts[:200]:
        assert np.frombuffer(encoder().packed(text), dtype="<u2").tolist() == bpe(text)


def test_pieces_equal_the_library(spark):
    codec = pieces.codec()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text, want in zip(texts, SP.encode(texts, add_bos=True, add_eos=True), strict=True):
        assert codec.ids(text) == want
        assert codec.decoded(want).decode() == SP.decode(want)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_pieces_of_any_text(text):
    codec, want = pieces.codec(), SP.encode(text, add_bos=True, add_eos=True)
    assert codec.ids(text) == want
    assert codec.decoded(want).decode() == SP.decode(want)


@pytest.mark.parametrize("text", [" " * n for n in range(40)] + [" " * n + "behalf" for n in range(20)]
                         + ["x" * 3000, " " * 500 + "留", "▁▁ a", "a  \n  b"])
def test_pieces_of_runs(text):
    assert pieces.codec().ids(text) == SP.encode(text, add_bos=True, add_eos=True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 258), max_size=12))
def test_decoding_any_ids(ids):
    assert pieces.codec().decoded(ids).decode() == SP.decode(ids)


def test_piece_digests_hard_rows(hard, empty, clashing):
    rows = hard_rows()
    for df in (hard, clashing):
        got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(df).collect()), key=repr)
        want = []
        for doc_id, text, *_ in rows:
            ids = SP.encode(text or "", add_bos=True, add_eos=True)
            want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                         hashlib.sha256(SP.decode(ids).encode()).hexdigest()))
        assert got == sorted(want, key=repr)
    assert pieces.digests(empty).count() == 0
    assert pieces.decode(pieces.encode(hard)).count() == len(rows)


def edited(text, edits):
    for start, end, new in sorted(edits, reverse=True):
        text = text[:start] + new + text[end:]
    return text


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=12), st.lists(st.tuples(st.floats(0, 1), st.integers(0, 300), TEXT), max_size=5))
def test_edited_counts_equal_a_full_count(parts, wishes):
    text, edits, at = " word ".join(parts) + LONG[:len(parts) * 150], [], 0
    for place, size, new in sorted(wishes):
        start = max(at, int(place * len(text)))
        end = min(len(text), start + size)
        if start <= end:
            edits.append((start, end, new))
            at = end + 1
    before, after, _ = tokencounts.count_edited(text, edits, encoder().count)
    assert (before, after) == (len(bpe(text)), len(bpe(edited(text, edits))))


def test_edits_encode_their_region_only():
    before, after, encoded = tokencounts.count_edited(LONG, [(20_000, 20_005, "new")], encoder().count)
    assert encoded < 1000 and after == len(bpe(edited(LONG, [(20_000, 20_005, "new")])))
    with pytest.raises(ValueError):
        tokencounts.count_edited("abcdef", [(0, 4, ""), (2, 5, "")], encoder().count)


def test_token_counts_hard_rows(hard, empty, clashing):
    want = sorted(((d, len(bpe(t)), len(e := tokencounts.masks(t or "")), len(bpe(edited(t or "", e))))
                   for d, t, *_ in hard_rows()), key=repr)
    for df in (hard, clashing):
        got = tokencounts.token_counts(df).collect()
        assert sorted(((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_edited) for r in got), key=repr) == want
    assert tokencounts.token_counts(empty).count() == 0


def test_masks():
    text = "write to a.b@c-d.org or 10.0.0.1, call +1 (743) 555-3824"
    assert edited(text, tokencounts.masks(text)) == "write to <EMAIL> or <IP>, call <NUMBER>"


def test_added_tokens_as_the_tokenizer_in_its_default_setting(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [end, f"a{end}b", f"a {end} b", f"x{end}{end}\n {end}  z", f"  {end}", end[:-1], f"{end[:5]}{end}{end[5:]}",
             f"one two {end} three " * 300, f"word{end}" * 200]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert any(50256 in ids for ids in want)
    assert [np.frombuffer(encoder().packed(t), dtype="<u2").tolist() for t in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencounts.token_counts(docs).collect()}
    assert got == {i: len(ids) for i, ids in enumerate(want)}
    ids = {}
    for p in packing.pack(docs, window=64).orderBy("doc_id", "start").collect():
        ids.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, dtype="<u4").tolist())
    assert ids == {i: [*w, 1] for i, w in enumerate(want)}
    for cut in range(len(texts[3]) + 1):  # an edit that makes or breaks the marker
        before, after, _ = tokencounts.count_edited(texts[3], [(cut, cut, end)], encoder().count)
        assert (before, after) == (len(want[3]), len(tokenizer.encode(texts[3][:cut] + end + texts[3][cut:]).ids))
