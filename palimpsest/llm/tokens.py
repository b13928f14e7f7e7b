"""Token ids of whole texts by a public tokenizer file, many times faster than text by text.

The tokenizer never joins characters across white space, so a text's ids are those of its white-space
separated chunks, and a chunk's ids are kept from text to text (in two generations of bounded size). A
chunk of Latin letters goes to the library's BPE model itself; all others to the library's encode().
Texts for which the parting isn't exact (not in NFC, or with the control characters that Python takes
for white space and the tokenizer doesn't) go to encode() whole. tests/llm holds this against the
library on whole texts. Tokenizer files other than the word-BPE kind are always encoded whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Entries of one generation of kept chunks.
KEPT = 450_000
END_ID = 1

_ODD = re.compile("[\x1c-\x1f]")
#: Letters below U+0250 whose lower case is one letter (U+0130 has two characters).
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
_TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"  # ASCII punctuation without ' (it starts pieces) and < > | (special tokens)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte as a printable character: itself, or one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Chunks(dict):
    """Chunk to the bytes of its ids."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.old = encoder, {}

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            got = self.encoder.chunk(chunk, self)
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[chunk] = got
        return got


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.parted = kinds == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.kept = _Chunks(self)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def chunk(self, chunk: str, kept: _Chunks) -> bytes:
        if _LATIN.fullmatch(chunk):
            return self._pack([t.id for t in self.model.tokenize(chunk.lower().encode().decode("latin-1").translate(self.letters))])
        core = chunk.rstrip(_TAIL)
        if len(core) < len(chunk) and _LATIN.fullmatch(core):
            return kept[core] + kept[chunk[len(core) :]]
        return self._pack(self.lib.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian integers of self.dtype, without an end id."""
        if not text:
            return b""
        if not self.parted or _ODD.search(text) or not unicodedata.is_normalized("NFC", text):
            return self._pack(self.lib.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.kept.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
