"""Token ids of whole texts, exactly those of a public tokenizer file, with caches.

The word tokenizer lower-cases, splits at white space and between letters and
punctuation, and never looks across such a border.  So the ids of a text are
those of its chunks, one after another, and frequent chunks need not be encoded
again.  What can't be split safely goes through the tokenizer as it is.
"""

from __future__ import annotations

import re

import numpy as np

#: ASCII letters, digits and the letters of Latin-1: lower-casing and normalising them is one to one.
_SAFE = "A-Za-z0-9À-ÖØ-öø-ÿ"
#: ASCII punctuation but the apostrophe, which joins contractions.
_MARKS = r"!-&(-/:-@\[-`{-~"
_PIECE = re.compile(rf"[{_SAFE}]+(?=[{_MARKS}]|\Z)|[{_MARKS}]+(?=[{_SAFE}]|\Z)|.+", re.DOTALL)
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
_LATIN = re.compile(r"[\x00-\xff]*\Z")
#: White space that str.split() and the tokenizer see alike; others go the long way.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85]")
#: Entries of a cache before it is emptied (some 60 MB).
MOST = 300_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The characters by which a byte-level vocabulary writes the bytes of letters."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 0x100 + i for i, b in enumerate(rest)}


_CACHES: dict[str, PieceTokenizer] = {}


class PieceTokenizer:
    """``encode(text)``: the ids as little-endian unsigned 32-bit numbers in bytes."""

    def __new__(cls, path: str) -> PieceTokenizer:
        if path not in _CACHES:  # Python workers live on from task to task
            _CACHES[path] = super().__new__(cls)
        return _CACHES[path]

    def __init__(self, path: str):
        if hasattr(self, "whole"):
            return
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.special = re.compile("|".join(map(re.escape, (t.content for t in self.whole.get_added_tokens_decoder().values()))) or r"(?!)")
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _long_way(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= MOST:
                self.pieces.clear()
            if _LETTERS.match(piece):
                word = piece.lower().encode("utf-8").decode("latin-1").translate(self.letters)
                found = np.array([t.id for t in self.whole.model.tokenize(word)], "<u4").tobytes()
            else:
                found = self._long_way(piece)
            if len(piece) < 64:
                self.pieces[piece] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        found = b"".join(map(self._piece, _PIECE.findall(chunk)))
        if len(chunk) < 64:
            if len(self.chunks) >= MOST:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if self.special.search(text) or _ODD_SPACE.search(text):
            return self._long_way(text)
        if _LATIN.match(text):
            text = text.lower()
        get, slow = self.chunks.get, self._chunk
        return b"".join([get(c) or slow(c) for c in text.split()])
