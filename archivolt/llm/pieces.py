"""Pieces of merge-type SentencePiece vocabularies: encoding by an agenda of pairs, and decoding.

The model file is read by the sentencepiece library, which names the pieces and
their scores; the merges are done here.  Adjacent symbols whose strings together
are a piece stand on an agenda; the pair of the highest score (of equal ones the
leftmost) is merged and its new neighbours join the agenda, until it is empty.
Characters that are no piece become the bytes of their UTF-8.

A merge never spans two characters that stand side by side in no piece, so a
text is cut there first, and the ids of a cut are remembered: texts repeat their
words.  What is remembered is bounded.  Every Arrow batch is then encoded by the
library as well, and a difference is an error.  Decoding is the library's.

Only models are taken whose text normalisation is the identity (spaces apart).
"""

from __future__ import annotations

import re
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivolt.llm.common import small_batches

#: How the vocabulary writes a space.
SPACE = "▁"
#: Remembered words or cuts before the older half is forgotten (some 150 MB), and the longest that is remembered.
MOST, LONGEST = 1_200_000, 48
#: Letters with signs behind them.
_ENDED = re.compile(r"([^\W\d_]+)([^\w]{1,8})\Z")
#: Characters whose treatment by the library tells whether a model changes texts.
_PROBE = "AÅﬁＡé　​\t\n\r  x"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memory:
    """Bytes by string, in two generations: what is asked again while the newer one fills up stays."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, key: str) -> bytes | None:
        """An entry of the older generation moves to the newer one; the caller has looked there already."""
        found = self.old.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, value: bytes) -> None:
        if len(self.new) >= MOST // 2:
            self.old = dict(self.new)
            self.new.clear()  # emptied in place: callers hold it
        self.new[key] = value


_CACHES: dict[str, PieceModel] = {}


class PieceModel:
    """``encode(text)``: ids as little-endian 32-bit numbers in bytes."""

    def __new__(cls, path: str) -> PieceModel:
        if path not in _CACHES:  # Python workers live on from task to task
            _CACHES[path] = super().__new__(cls)
        return _CACHES[path]

    def __init__(self, path: str):
        if hasattr(self, "library"):
            return
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(_PROBE) != (SPACE + _PROBE).replace(" ", SPACE):
            raise ValueError(f"{path} changes texts before it encodes them")
        size = sp.get_piece_size()
        self.end = np.array([sp.eos_id()], "<i4").tobytes()
        self.ids: dict[str, int] = {}  # pieces that merges may make
        self.bytes = [sp.unk_id()] * 256
        scores = np.zeros(size)
        for i in range(size):
            piece, scores[i] = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif sp.is_unused(i):
                raise ValueError(f"{path} has unused pieces")
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[piece] = i
        # the place of every score among all, best first: equal scores share a place
        self.place = dict(enumerate(np.unique(-scores, return_inverse=True)[1].tolist()))
        self.beside = {a + b for piece in self.ids for a, b in zip(piece, piece[1:])}
        self.pairs = self._pairs()
        self.cuts, self.words = _Memory(), _Memory()

    def _pairs(self) -> dict[str, dict[str, tuple[int, str]]]:
        """By left, then right symbol: (place, merged) of every two that may merge; both are pieces or single characters."""
        symbol = lambda s: len(s) == 1 or s in self.ids
        found: dict[str, dict[str, tuple[int, str]]] = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if symbol(p[:k]) and symbol(p[k:]):
                    found.setdefault(p[:k], {})[p[k:]] = (self.place[i], p)
        return found

    def merged(self, cut: str) -> list[str]:
        """The symbols of a cut when no more pairs can merge."""
        symbols: list[str | None] = list(cut)
        last, pairs, nothing = len(symbols), self.pairs, {}
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        agenda, left = [], symbols[0]
        for i in range(1, last):
            right = symbols[i]
            found = pairs.get(left, nothing).get(right)
            if found is not None:
                agenda.append((found[0], i - 1, found[1]))
            left = right
        heapify(agenda)
        while agenda:
            _, i, made = heappop(agenda)
            left = symbols[i]
            if left is None or (j := after[i]) == last or left + symbols[j] != made:
                continue  # one of the two has merged with another symbol since
            symbols[i], symbols[j] = made, None
            k = after[i] = after[j]
            if k < last:
                before[k] = i
                found = pairs.get(made, nothing).get(symbols[k])
                if found is not None:
                    heappush(agenda, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = pairs.get(symbols[h], nothing).get(made)
                if found is not None:
                    heappush(agenda, (found[0], h, found[1]))
        return [s for s in symbols if s is not None]

    def _made(self, cut: str) -> bytes:
        out: list[int] = []
        ids = self.ids
        for symbol in self.merged(cut):
            found = ids.get(symbol)
            if found is None:
                out += [self.bytes[b] for b in symbol.encode()]
            else:
                out.append(found)
        return struct.pack(f"<{len(out)}i", *out)

    def _cut(self, cut: str) -> bytes:
        """A cut's ids; one that starts with a space sign is remembered as the word behind it."""
        memory, key = (self.words, cut[1:]) if cut[0] == SPACE else (self.cuts, cut)
        found = memory.new.get(key) or memory.find(key)
        if found is None:
            found = self._made(cut)
            if len(cut) <= LONGEST:
                memory.keep(key, found)
        return found

    def _run(self, run: str) -> bytes:
        """A run that starts with a space sign: cut where no piece has both characters."""
        beside, start, out = self.beside, 0, []
        for i, pair in enumerate(map(str.__add__, run, run[1:]), 1):
            if pair not in beside:
                out.append(self._cut(run[start:i]))
                start = i
        out.append(self._cut(run[start:]))
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """A word that isn't in the newer memory; one of letters alone is hardly ever cut, so it is merged as it is."""
        if word.isalpha():
            return self._cut(SPACE + word)
        found = self.words.find(word)
        if found is None:
            ended = _ENDED.match(word)
            if ended and ended[1][-1] + ended[2][0] not in self.beside:
                found = self._cut(SPACE + ended[1]) + self._cut(ended[2])
            else:
                found = self._run(SPACE + word)
            if len(word) <= LONGEST:
                self.words.keep(word, found)
        return found

    def encode(self, text: str, end: bool = True) -> bytes:
        if not text:
            return self.end if end else b""
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            out = self._run(SPACE + text.replace(" ", SPACE))
        else:
            get, slow = self.words.new.get, self._word
            out = b"".join([get(w) or slow(w) for w in text.split(" ")])
        return out + self.end if end else out


def _lists(values: list[bytes | None]) -> pa.Array:
    sizes = np.array([0, *(len(v) // 4 if v is not None else 0 for v in values)], np.int64)
    offsets = pa.array(np.cumsum(sizes).astype(np.int32), mask=np.array([*(v is None for v in values), False]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(v for v in values if v), "<i4")))


def encode(docs: DataFrame, *, text: str = "text", into: str = "ids", model: str | None = None, end: bool = True, check: bool = True) -> DataFrame:
    """``docs`` with ``into``: the ids of each whole text as array<int>, the end id last if ``end``.

    A null text has null ids; an empty one has the end id alone.  Equal texts have
    equal ids, an empty table stays empty.  A column that is already named like
    ``into`` is an error.  ``check`` has the library encode every batch too; a
    difference is an error that quotes the text's start.
    """
    path = model or model_path()

    def encoded(texts: pa.Array) -> pa.Array:
        own, held = PieceModel(path), texts.to_pylist()
        out = [None if t is None else own.encode(t, end) for t in held]
        if check:
            some = [t for t in held if t is not None]
            for t, ids, want in zip(some, (v for v in out if v is not None), own.library.encode(some, add_eos=end, num_threads=1)):
                if ids != np.array(want, "<i4").tobytes():
                    raise ValueError(f"the library encodes otherwise: {t[:60]!r}")
        return _lists(out)

    return _with(docs, into, F.arrow_udf(encoded, T.ArrayType(T.IntegerType())).asNondeterministic()(F.col(f"`{text}`")))


def decode(docs: DataFrame, *, ids: str = "ids", into: str = "decoded", model: str | None = None) -> DataFrame:
    """``docs`` with ``into``: the text of each list of ids, by the library; null for null, empty for an empty list.

    Null elements are an error, as is an id outside the vocabulary or a column
    named like ``into``.  Decoding merges nothing, so the library's is taken as it is.
    """
    path = model or model_path()

    def decoded(lists: pa.Array) -> pa.Array:
        flat, ends, valid = lists.values.to_numpy(zero_copy_only=False).tolist(), lists.offsets.to_pylist(), lists.is_valid().to_pylist()
        held = [flat[a:b] for a, b, ok in zip(ends, ends[1:], valid) if ok]
        texts = iter(PieceModel(path).library.decode(held) if held else [])
        return pa.array([next(texts) if ok else None for ok in valid], pa.string())

    return _with(docs, into, F.arrow_udf(decoded, T.StringType()).asNondeterministic()(F.col(f"`{ids}`")))


def _with(docs: DataFrame, into: str, column: Column) -> DataFrame:
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the table has a column {into} already")
    return small_batches(docs).withColumn(into, column)


def digest(coded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The contract's columns."""
    return coded.select(
        F.col(doc_id).alias("doc_id"),
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids, " "), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )
