"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items become one suffix automaton.  Every
document streams its words through it; the automaton's state and the length of
the longest match are all that is kept.  Where that length reaches the window,
the matched words are contaminated.

The documents are never shuffled.  The items are the stated query set: equal
texts are read once, in blocks of at most ``block_words`` words, long items cut
with an overlap that keeps every window whole; each block is one broadcast
automaton of bounded size.  A pass over the documents tokenises them once and
asks up to ``BLOCKS_AT_ONCE`` automata; a larger benchmark takes further passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import fresh, materialize, small_batches

#: A window: so many consecutive item words.
WINDOW = 10
#: Words of test items in one automaton (about 30 MB in a Python worker).
BLOCK_WORDS = 50_000
#: Automata that a Python worker holds at a time (about 250 MB).
BLOCKS_AT_ONCE = 8
#: A cleaned document of which more than this share was contaminated is dropped.
MAX_COVERAGE = 0.8

#: ASCII letters are folded, other ASCII except digits separates words; bytes of other characters stay.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)

_RESULT = "n_words long, hits array<struct<start:int,stop:int>>, items array<string>, longest int"


def words_of(text: str | None) -> list[bytes]:
    """The normalised words; null has none."""
    return [] if text is None else text.encode("utf-8").translate(_FOLD).split()


@dataclass
class Automaton:
    """A generalised suffix automaton over word numbers.

    ``step`` maps ``state * len(vocabulary) + word`` to the next state.  For a
    state whose strings reach the window, ``windows`` has the items in which its
    window occurs; ``shorts`` has the short items that end there, with lengths.
    """

    vocabulary: dict[bytes, int]
    step: dict[int, int]
    link: list[int]
    length: list[int]
    at_window: list[int]
    windows: dict[int, set[str]]
    shorts: dict[int, list[tuple[int, list[str]]]]
    least: int


def build(items: list[tuple[list[str], list[bytes]]], window: int = WINDOW) -> Automaton:
    """The automaton of (ids of the items, words); items without words add nothing.

    Items without an id mark words but are named nowhere.
    """
    items = [(i, w) for i, w in items if w]
    vocabulary: dict[bytes, int] = {}
    coded = [[vocabulary.setdefault(w, len(vocabulary)) for w in words] for _, words in items]
    base = max(len(vocabulary), 1)
    step: dict[int, int] = {}
    link, length = [-1], [0]
    edges: list[list[int]] = [[]]  # the words that leave a state, for copies

    def new(n: int, to: int, words: list[int]) -> int:
        link.append(to)
        length.append(n)
        edges.append(words)
        return len(link) - 1

    def copy(p: int, word: int) -> int:
        """Split the state that ``word`` reaches from p, so that it ends at p's length."""
        q = step[p * base + word]
        twin = new(length[p] + 1, link[q], list(edges[q]))
        for w in edges[q]:
            step[twin * base + w] = step[q * base + w]
        link[q] = twin
        while p >= 0 and step.get(p * base + word) == q:
            step[p * base + word] = twin
            p = link[p]
        return twin

    for words in coded:
        last = 0
        for word in words:
            p = last
            q = step.get(p * base + word)
            if q is not None:  # an earlier item has this string already
                last = q if length[q] == length[p] + 1 else copy(p, word)
                continue
            last = new(length[p] + 1, 0, [])
            while p >= 0 and p * base + word not in step:
                step[p * base + word] = last
                edges[p].append(word)
                p = link[p]
            if p >= 0:
                q = step[p * base + word]
                link[last] = q if length[q] == length[p] + 1 else copy(p, word)

    order = sorted(range(len(link)), key=length.__getitem__)
    at_window = [-1] * len(link)
    for s in order[1:]:
        if length[s] >= window:
            at_window[s] = s if length[link[s]] < window else at_window[link[s]]
    windows: dict[int, set[str]] = {}
    ends: dict[int, list[tuple[int, list[str]]]] = {}
    for (names, _), words in zip(items, coded, strict=True):
        s = 0
        for i, word in enumerate(words):
            s = step[s * base + word]
            # s holds the whole prefix; its window is that of an ancestor
            if i + 1 >= window:
                windows.setdefault(at_window[s], set()).update(names)
        if len(words) < window:
            ends.setdefault(s, []).append((len(words), names))
    shorts: dict[int, list[tuple[int, list[str]]]] = {}
    for s in order:
        got = ends.get(s, []) + (shorts.get(link[s], []) if link[s] >= 0 else [])
        if got:
            shorts[s] = got
    least = min([window, *(len(w) for w in coded)]) if coded else window
    return Automaton(vocabulary, step, link, length, at_window, windows, shorts, least)


def _runs(known: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The maximal runs of known words that are long enough to hold a window."""
    edge = np.diff(np.concatenate(([0], known.view(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = stops - starts >= least
    return list(zip(starts[long].tolist(), stops[long].tolist(), strict=True))


def scan(words: list[bytes], a: Automaton, window: int = WINDOW) -> tuple[list[tuple[int, int]], set[str], int]:
    """Contaminated word ranges (half open, apart), the items, and the longest match."""
    hits: list[tuple[int, int]] = []
    found: set[str] = set()
    longest, base, step, link, length = 0, max(len(a.vocabulary), 1), a.step, a.link, a.length
    known = np.fromiter(map(a.vocabulary.__contains__, words), bool, len(words))
    for start, stop in _runs(known, a.least):
        state = n = 0
        seen: set[int] = set()
        for i in range(start, stop):
            word = a.vocabulary[words[i]]
            while state and state * base + word not in step:
                state = link[state]
                n = length[state]
            state = step.get(base * state + word, 0)
            n = n + 1 if state else 0
            longest = max(longest, n)
            reach = 0
            if n >= window:
                reach = n
                seen.add(a.at_window[state])
            for m, names in a.shorts.get(state, ()):
                if m <= n:
                    reach = max(reach, m)
                    found.update(names)
            if reach:
                low = i + 1 - reach
                while hits and hits[-1][1] >= low:
                    low = min(low, hits.pop()[0])
                hits.append((low, i + 1))
        for s in seen:
            found |= a.windows[s]
    return hits, found, longest


def _joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(a + b):
        if out and out[-1][1] >= low:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int, window: int) -> Iterator[list[tuple[list[str], list[bytes]]]]:
    """Different item texts with their ids, in blocks of about ``block_words`` words; one pass, a partition at a time."""
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    same = rows.groupBy("text").agg(F.collect_set("id").alias("ids"))
    block: list[tuple[list[str], list[bytes]]] = []
    held = 0
    for r in same.toLocalIterator():
        words = words_of(r["text"])
        for at in range(0, max(1, len(words) - window + 1), block_words):  # a part starts block_words on, so each window is whole in one
            part = words[at : at + block_words + window - 1]
            if held and held + len(part) > block_words:
                yield block
                block, held = [], 0
            block.append((r["ids"], part))
            held += len(part)
    yield block


def _scanner(shared: list[Broadcast], window: int):
    def scanned(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, before in batches:
            rows = []
            for value, hits, items, longest in zip(texts, before["hits"], before["items"], before["longest"], strict=True):
                words = words_of(value)
                hits, items = [(h["start"], h["stop"]) for h in hits], set(items)
                for block in shared:
                    more, found, most = scan(words, block.value, window)
                    hits = _joined(hits, more) if hits else more
                    items |= found
                    longest = max(longest, most)
                rows.append((len(words), [{"start": s, "stop": e} for s, e in hits], sorted(items), longest))
            yield pd.DataFrame(rows, columns=["n_words", "hits", "items", "longest"])

    return scanned


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    into: str = "contamination",
) -> DataFrame:
    """``docs`` with ``into``: n_words, hits, items, longest.

    ``hits`` are word ranges, half open, in order and apart; ``items`` the ids of
    the items with a window in the document, sorted as strings; ``longest`` the
    longest match with an item or, of an item longer than a block, with a part.
    Null and empty texts have no words; repeated documents and items are each
    judged alone, so a tie can't matter; an empty table of items marks nothing.
    All columns of ``docs`` stay; an earlier column ``into`` is replaced.
    """
    spark = docs.sparkSession
    nothing = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,stop:int>>").alias("hits"), F.array().cast("array<string>").alias("items"), F.lit(0).alias("longest"))
    out = docs.withColumn(into, nothing)
    for k, blocks in enumerate(batched(_blocks(items, item_id, item_text, block_words, window), BLOCKS_AT_ONCE)):
        if k:  # the automata of the pass before leave the workers
            out = materialize(out, "contamination")
        shared = [spark.sparkContext.broadcast(build(block, window)) for block in blocks]
        udf = F.pandas_udf(_scanner(shared, window), _RESULT).asNondeterministic()  # evaluated once, whatever reads it
        out = small_batches(out).withColumn(into, udf(F.col(f"`{text}`"), F.col(f"`{into}`")))
    return out


def _cut(text: str, hits: list[tuple[int, int]]) -> str:
    """The text without the hit words and what stands between them."""
    raw = text.encode("utf-8")
    solid = np.frombuffer(raw.translate(_FOLD), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for low, high in hits:
        kept.append(raw[at : starts[low]])
        at = stops[high - 1]
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8")


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", max_coverage: float = MAX_COVERAGE, **how) -> DataFrame:
    """``docs`` with the contaminated spans cut out of ``text``.

    A document of which more than ``max_coverage`` of the words are contaminated
    goes as a whole.  Documents without a hit, null and empty texts included, come
    back unchanged; equal rows fare alike; empty tables are fine on either side.
    Columns stay as they were.
    """
    mark = fresh(docs, "contamination")
    found = find_contamination(docs, items, text=text, into=mark, **how)
    n_hit = F.aggregate(F.col(mark)["hits"], F.lit(0).cast("long"), lambda n, h: n + (h["stop"] - h["start"]))
    kept = found.where(n_hit <= F.lit(max_coverage) * F.col(mark)["n_words"])

    @F.pandas_udf("string")
    def cut(texts: pd.Series, marks: pd.DataFrame) -> pd.Series:
        return pd.Series([_cut(t, [(h["start"], h["stop"]) for h in m]) if t is not None and len(m) else t for t, m in zip(texts, marks["hits"], strict=True)], dtype=object)

    hits = F.struct(F.col(mark)["hits"].alias("hits"))
    return kept.withColumn(text, cut(F.col(f"`{text}`"), hits)).select([F.col(f"`{c}`") for c in docs.columns])


def with_digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The contract's columns from ``contamination``."""
    c = F.col("contamination")
    n_hit = F.aggregate(c["hits"], F.lit(0).cast("long"), lambda n, h: n + (h["stop"] - h["start"]))
    return found.select(
        F.col(doc_id).alias("doc_id"),
        c["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


__all__ = ["Automaton", "build", "decontaminate", "find_contamination", "scan", "with_digest", "words_of"]
