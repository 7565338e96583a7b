"""Tokenizer files as parameters, with a bounded cache of pieces per chunk."""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Iterable

import numpy as np

#: Chunks, and pieces, that a worker keeps.
CACHE_CHUNKS = 400_000
#: Longer chunks are never kept.
CACHE_CHARS = 64


def load(path: str):
    """A tokenizer of the tokenizers library, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


#: Texts of these characters only are cut below as CUT does: the letters here are all that \p{L} finds in them, \p{N}
#: finds the digits, and they are in normal form. İ is left out, as its lower case is not one letter.
_LATIN = re.compile("[\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]*")
#: The same pieces as CUT finds in those: what starts with a letter or digit can be tried first.
_PARTS = re.compile("[a-z\u00DF-\u00F6\u00F8-\u017F]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^ \t-\ra-z0-9\u00DF-\u00F6\u00F8-\u017F]+")
#: Fixed value: the splitting pattern of a tokenizer for which _PARTS may stand.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Kept:
    """Values by string in two generations: when the young one is full the old one goes, so what is met often stays."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Those of the keys without a value; values of the old generation move to the young one."""
        if len(self.young) > CACHE_CHUNKS // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = [k for k in keys if k not in young]
        if old:
            young.update((k, old[k]) for k in out if k in old)
            out = [k for k in out if k not in young]
        return out


class ChunkEncoder:
    """Ids of texts for a tokenizer that drops white space: a text's ids are those of its pieces, one after the other.

    Such a tokenizer turns every white space into a separator before it splits, so no piece, added token or normal form
    reaches over a blank, tab or line end. Texts of Latin letters, digits and marks are cut into the tokenizer's own
    pieces, if its splitting pattern can be seen to be safe, so that a word is encoded once for all marks around it; new
    pieces of a block of texts are encoded in one call. Other texts are looked up by chunk, from blank to blank. Ids are
    kept as little-endian unsigned 32-bit numbers.
    """

    def __init__(self, path: str):
        import regex

        self.tokenizer = load(path)
        parts = json.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        split = ((parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        known = normal == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed"
        self.pattern = regex.compile(split["pattern"]["Regex"]) if known else None
        self.latin = known and split["pattern"]["Regex"] == CUT
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.marks = frozenset(x[0] for x in self.special)
        self.pieces, self.chunks = _Kept(), _Kept()

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces, each a word to the tokenizer, as one text."""
        known = self.pieces.young
        if pieces:
            found = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
            edges = np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(pieces) + 1))
            if found.word_ids[-1:] == [len(pieces) - 1] and (np.diff(edges) > 0).all():
                data, at = np.array(found.ids, dtype="<u4").tobytes(), (4 * edges).tolist()
                known.update((p, data[a:b]) for p, a, b in zip(pieces, at, at[1:]))
            else:
                known.update((p, self._encode(p)) for p in pieces)

    def _join(self, chunk: str) -> bytes:
        """A chunk's ids by its parts, or as a whole where its normal form can't be made here or it may hold a special token."""
        low = chunk.lower()
        formed = chunk.isascii() or "\u03a3" not in chunk and unicodedata.is_normalized("NFC", chunk) and unicodedata.is_normalized("NFC", low)
        if self.pattern is None or not formed or not self.marks.isdisjoint(chunk):
            return self._encode(chunk)
        own = self.pattern.findall(low)
        self.pieces.young.update((p, self._encode(p)) for p in self.pieces.missing(own))
        return b"".join(map(self.pieces.young.__getitem__, own))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text of a block."""
        texts = [text or "" for text in texts]
        plain = [self.latin and _LATIN.fullmatch(text) is not None and not any(x in text for x in self.special) for text in texts]
        words = [_PARTS.findall(text.lower()) if flat else re.sub("[\n\t\r]", " ", text).split(" ") for text, flat in zip(texts, plain)]
        for chunk in (new := self.chunks.missing({w for own, flat in zip(words, plain) if not flat for w in own})):
            self.chunks.young[chunk] = self._join(chunk)
        new += (pieces := self.pieces.missing(set().union(*(own for own, flat in zip(words, plain) if flat))))
        self._learn(pieces)
        tables = self.chunks.young.__getitem__, self.pieces.young.__getitem__
        out = [b"".join(map(tables[flat], own)) for own, flat in zip(words, plain)]
        for k in new:
            if len(k) > CACHE_CHARS:
                self.chunks.young.pop(k, None), self.pieces.young.pop(k, None)
        return out


@functools.cache
def encoder(path: str) -> ChunkEncoder:
    """The encoder of a Python worker, which keeps its pieces from task to task."""
    return ChunkEncoder(path)
