"""Byte-level BPE ids, and places where a text may be cut without changing them.

The pre-token pattern of the vocabulary attaches at most one leading space to a token, and white
space runs never reach past a visible character. A single space with a visible character on both
sides is therefore always the start of a pre-token: a text may be cut there and the parts encoded
apart; their ids in order are those of the whole text. Added tokens of the vocabulary's tokenizer file
(``<|endoftext|>``) get their own ids where they occur in a text, as the tokenizer gives them; they
hold no white space, so no cut falls inside one.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array

import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k.tiktoken"

_CUT = re.compile(r"(?<=\S) (?=\S)")


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer file and their ids; none if there is no such file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    for token in added:
        if any(token[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(map(str.isspace, token["content"])):
            raise ValueError(f"added token {token['content']!r} needs its surroundings")
    return {token["content"]: token["id"] for token in added}


class BytePairs:
    """Encoder of one worker process; see :func:`encoder`."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        added = added_tokens(os.path.splitext(path)[0] + ".json")
        if max([*ranks.values(), *added.values()]) > 0xFFFF:
            raise ValueError("ids are packed in 16 bits")
        self._encoding = tiktoken.Encoding("byte-pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                           special_tokens=added)
        self._added = set(added)

    def ids(self, text: str) -> list[int]:
        if any(token in text for token in self._added):
            return self._encoding.encode(text, allowed_special=self._added, disallowed_special=())
        return self._encoding.encode_ordinary(text)

    def packed(self, text: str | None) -> bytes:
        """Ids of the text as little-endian unsigned 16-bit integers (null: none)."""
        return array("H", self.ids(text)).tobytes() if text else b""

    def count(self, text: str) -> int:
        return len(self.ids(text))


def next_cut(text: str, at: int) -> int:
    """The first safe cut at or after ``at``; the end of the text if there is none."""
    found = _CUT.search(text, max(at, 0))
    return found.start() if found else len(text)


_ENCODERS: dict[str, BytePairs] = {}


def encoder(path: str | None = None) -> BytePairs:
    """The worker's encoder for a vocabulary file (by default the public one), built once."""
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairs(path)
    return _ENCODERS[path]
