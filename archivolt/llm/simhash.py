"""SimHash near-duplicates over a Gray-order hierarchical index.

Documents become 64-bit fingerprints.  Fingerprints that differ in at most three
bits agree on all but three of ``b`` blocks of bits, so every link is found
within a group of equal kept blocks (``b`` choose 3 keys per fingerprint).  In a
group the fingerprints are sorted by Gray rank; runs of neighbours share a node
that holds the bits they all agree on, nodes share upper nodes, and each child
holds only the bits its parent doesn't.  A search walks down from the root,
adds up the differences and drops a whole node once they exceed three.

Links leave a group as a star (each fingerprint to the smallest of its local
component), never as all pairs; components are then joined over all groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import fresh, materialize, small_batches
from archivolt.llm.components import components

MOST_BITS = 3
SHINGLE = 3
#: Rows of a key that one task compares; fingerprints of larger groups get longer keys.
GROUP_ROWS = 4096
#: Members of a node of the index.
FAN = 16
#: Distinct fingerprints up to which 4 and 5 blocks of bits are used; 6 beyond.  It only sets how long the keys are.
FEW, MANY = 1 << 22, 1 << 30
#: Hashes held at a time while a document is counted.
_STRIDE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash; zero for a text without words."""
    if text is None:
        return 0
    words = text.encode("utf-8").lower().split()  # bytes: folds A-Z and splits at ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), 42)
    ones, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, _STRIDE):
        part = words[at : at + _STRIDE + shingle - 1]
        rows = zip(*(part[i:] for i in range(shingle)))  # noqa: B905  the shortest ends it
        hashes = np.array([digest(x, 42) for x in map(b" ".join, rows)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), index=texts.index)


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` and the fingerprint as a signed long; null and empty texts have zero.

    An empty table stays empty; a column that is already named like ``into`` is replaced.
    """
    return small_batches(docs).withColumn(into, F.pandas_udf(_fingerprints, "long").asNondeterministic()(F.col(f"`{text}`")))


def gray_rank(x: Column) -> Column:
    """The place of a fingerprint in Gray order: neighbours differ in few bits."""
    for by in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, by))
    return x


def _masks(blocks: int, differ: int) -> list[int]:
    """Masks of the bits kept, for each choice of blocks that may differ."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (high - low)) - 1) << low for low, high in zip(edges, edges[1:])]  # noqa: B905
    return [sum(block[i] for i in kept) for kept in combinations(range(blocks), blocks - differ)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class GrayIndex:
    """The index over groups of fingerprints that are sorted by (group, Gray rank)."""

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        self.prints = prints
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # value, mask, first child, end
        ones, zeros, groups = prints, ~prints, group
        while True:
            head = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
            place = np.arange(len(groups)) - np.repeat(head, np.diff(np.append(head, len(groups))))
            first = np.flatnonzero(place % FAN == 0)
            end = np.append(first[1:], len(groups))
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            groups = groups[first]
            self.levels.append((ones, ones | zeros, first, end))
            if len(first) == len(head):  # one node a group
                break
        self.roots = np.searchsorted(groups, group)

    def links(self, low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later member of its group) within ``most`` bits, for the queries low..high."""
        query, node = np.arange(low, high), self.roots[low:high]
        value, mask, _, _ = self.levels[-1]
        above = mask[node]
        apart = np.bitwise_count((self.prints[query] ^ value[node]) & above).astype(np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            _, _, first, end = self.levels[depth]
            keep = apart <= most
            query, node, above, apart = query[keep], node[keep], above[keep], apart[keep]
            many = end[node] - first[node]
            start = np.cumsum(many) - many
            child = np.arange(many.sum()) - np.repeat(start - first[node], many)
            query, above, apart = np.repeat(query, many), np.repeat(above, many), np.repeat(apart, many)
            if depth:
                value, mask, _, _ = self.levels[depth - 1]
                apart += np.bitwise_count((self.prints[query] ^ value[child]) & mask[child] & ~above)
                node, above = child, mask[child]
            else:
                later = child > query
                query, child, above, apart = query[later], child[later], above[later], apart[later]
                apart += np.bitwise_count((self.prints[query] ^ self.prints[child]) & ~above)
        near = apart <= most
        return query[near], child[near]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of the pairs; labels are the smallest member's place."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def local_stars(group: np.ndarray, prints: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the components within groups; input sorted by (group, Gray rank)."""
    index, label = GrayIndex(group, prints), np.arange(len(prints))
    sizes = np.diff(np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(group)))
    cost = np.cumsum(np.repeat(sizes, sizes))  # pairs to look at, at worst
    at = 0
    while at < len(prints):
        stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + 2_000_000, "right")))
        _unite(label, *index.links(at, stop, most))
        at = stop
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return prints[moved], prints[label[moved]]


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups at a time from rows sorted by (mask, key, slice pair, Gray rank)."""
    held: list[pd.DataFrame] = []
    n = 0

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows[["m", "key", "pair"]].to_numpy(np.int64)
        group = np.cumsum(np.concatenate(([0], np.any(keys[1:] != keys[:-1], axis=1).astype(np.int64))))
        a, b = local_stars(group, rows["fp"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < 20_000:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = rows[["m", "key", "pair"]].iloc[-1]
        open_from = int(np.argmax(((rows["m"] == last["m"]) & (rows["key"] == last["key"]) & (rows["pair"] == last["pair"])).to_numpy()))
        if open_from:
            yield solve(rows.iloc[:open_from])
        held, n = [rows.iloc[open_from:]], len(rows) - open_from
    if n:
        yield solve(pd.concat(held, ignore_index=True))


def _dealt(keyed: DataFrame) -> DataFrame:
    """Rows of keys with ``slices`` as pairs of slices: every two rows of a key meet in one of them."""
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda i: F.least(F.col("own"), i) * F.col("slices") + F.greatest(F.col("own"), i),
    )
    whole = keyed.withColumn("slices", F.coalesce("slices", F.lit(1)))
    return whole.withColumn("own", own).select("m", "key", "fp", F.explode(pairs).alias("pair"))


def _keys(rows: DataFrame, masks: list[int], base: Column) -> DataFrame:
    """(m, key, fp): a row per fingerprint and mask that keeps all bits of ``base``, numbered by mask."""
    choices = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(m).alias("mask")) for i, m in enumerate(masks)])
    wider = F.filter(choices, lambda c: c["mask"].bitwiseAND(F.col("base")) == F.col("base"))
    return rows.withColumn("base", base).select("fp", F.explode(wider).alias("k")).select("fp", "k.m", F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"))


def near_links(prints: DataFrame, *, group_rows: int = GROUP_ROWS, blocks: int | None = None) -> DataFrame:
    """Star links (a, b) of the distinct fingerprints ``fp``; their components are those of all links.

    Fingerprints of a key that too many share get longer keys: blocks half as
    long, of which again all but ``MOST_BITS`` agree, those of the short key
    among them.  Only what is still crowded then is dealt out as pairs of slices.
    """
    count = prints.count()
    blocks = blocks or (4 if count <= FEW else 5 if count <= MANY else 6)
    masks, finer = ([_signed(m) for m in _masks(b, MOST_BITS)] for b in (blocks, 2 * blocks))

    def crowded(keyed: DataFrame) -> DataFrame:
        """A row per key that is too large."""
        large = keyed.groupBy("m", "key").agg(F.count("*").alias("n")).where(F.col("n") > group_rows)
        return materialize(large.select("m", "key", F.ceil(F.col("n") / group_rows).cast("int").alias("slices")), "crowded")

    keyed = _keys(prints.select("fp"), masks, F.lit(0).cast("long"))
    large = crowded(keyed)
    dealt = keyed.withColumn("pair", F.lit(0))
    if not large.isEmpty():
        short = dealt.join(large, ["m", "key"], "left_anti").select("m", "key", "fp", "pair")
        again = keyed.join(large.select("m", "key"), ["m", "key"], "left_semi")
        base = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("m") + 1)
        long = _keys(again.select("fp", "m"), finer, base).select((F.col("m") + len(masks)).alias("m"), "key", "fp").distinct()
        long = materialize(long, "keys")
        slices = crowded(long)
        dealt = short.unionByName(_dealt(long.join(slices, ["m", "key"], "left")))
    ordered = dealt.repartition("m", "key", "pair").sortWithinPartitions("m", "key", "pair", gray_rank(F.col("fp")))
    return ordered.mapInPandas(_stars, "a long, b long").distinct()


def _text_hash(text: Column) -> Column:
    """Tells the texts of one id apart; null is a text like any other."""
    return F.xxhash64(text, F.lit(3))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fingerprint as signed long, component_id), a row per row of ``docs``.

    ``component_id`` is the smallest id that links reach.  Texts without words,
    null ones included, share the fingerprint zero.  Repeated rows and ids are
    kept; null ids count in no minimum, so a component of null ids alone has a
    null one.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marked = materialize(with_fingerprint(rows).select("doc_id", _text_hash(F.col("text")).alias("text_hash"), "fingerprint"), "fingerprints")
    classes = materialize(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "prints")
    roots = components(near_links(classes.select("fp")))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tops = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(tops, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "text_hash", "fingerprint", "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest id of each component, all columns as they were.

    A row goes if its id isn't the smallest of its own text's component, so rows
    of one id with different texts are judged apart.  Rows that repeat a kept id
    and text stay; rows with a null id stay, as nothing can name them.  Null and
    empty texts are copies of one another; an empty table stays empty.
    """
    key, mark = fresh(docs, "gone_id"), fresh(docs, "gone_text")
    found = near_duplicates(docs, doc_id=doc_id, text=text).where(F.col("doc_id") != F.col("component_id"))
    gone = found.select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark)).distinct()
    return docs.join(gone, (docs[f"`{doc_id}`"] == gone[key]) & (_text_hash(docs[f"`{text}`"]) == gone[mark]), "left_anti")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
