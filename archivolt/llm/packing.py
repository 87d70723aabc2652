"""Best-fit packing of tokenised documents by a configuration linear program.

Only the histogram of piece lengths reaches the driver: at most ``capacity``
counts, however many documents there are.  A configuration is a multiset of
lengths that fits a sequence.  The covering program over configurations is
solved by multiplicative weights: each step prices the lengths by how little
they are covered, finds the best configuration by a knapsack dynamic program and
adds it.  Rounding takes whole copies as long as the counts allow; what is left
is packed best fit first, on counts as well, so its cost doesn't follow the data.
Where best fit alone needs fewer sequences than the rounded program, its plan is taken.

The plan gives every length ranges of ranks, each with a configuration and a
place in it.  A piece finds its range by its rank among the pieces of its length
and computes its sequence and offset; the pieces of a frequent length are salted
and ranked within a salt, so no length is gathered in one task.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from archivolt.llm.common import fresh, materialize, small_batches
from archivolt.llm.tokens import PieceTokenizer, tokenizer_path

CAPACITY = 2048
#: Id that ends every document.
END_ID = 0
#: Pieces of one length that a task ranks, about; longer lists get as many salts as that takes.
RANKED = 200_000
#: Pricing steps of the multiplicative weights method, their step size, and how fast a worse configuration is left.
STEPS = 60
STEP_SIZE = 0.05
SHARPNESS = 20.0


# --- the plan, from the histogram -------------------------------------------------


def price(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """An unbounded knapsack by dynamic programming: for each room the best worth and a length to take for it (-1: none)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        best[room], pick[room] = best[room - 1], pick[room - 1]
        if n := upto[room]:
            value = worth[:n] + best[room - lengths[:n]]
            i = int(value.argmax())
            if value[i] > best[room] + 1e-12:
                best[room], pick[room] = value[i], i
    return best, pick


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, steps: int = STEPS) -> dict[tuple[tuple[int, int], ...], float]:
    """An approximate solution of the configuration program: copies of each configuration.

    Dual prices of the lengths follow multiplicative weights.  A step prices all
    configurations by one knapsack program and reads off, for every length, the
    best configuration that holds it; each length asks for its count there, less
    where that configuration is far from the best of all.  Prices of lengths that
    are used more than their count fall, others rise.  The answer is the mean of
    the second half of the steps.
    """
    price_of = lengths / capacity
    size = float((lengths * counts).sum())
    picked: Counter[tuple[tuple[int, int], ...]] = Counter()
    width = [int(n) for n in lengths]
    for step in range(steps):
        best, pick = price(lengths, price_of, capacity)
        value = price_of + best[capacity - lengths]
        asked = counts * np.exp(SHARPNESS * (value / value.max() - 1))
        take, used, columns = pick.tolist(), np.zeros(len(lengths)), []
        for i, n in enumerate(width):
            config, room = Counter({i: 1}), capacity - n
            while (j := take[room]) >= 0:
                config[j] += 1
                room -= width[j]
            times = asked[i] / config[i]
            for j, many in config.items():
                used[j] += many * times
            columns.append((tuple(sorted(config.items())), times))
        mean = float((used * lengths).sum()) / size
        if 2 * step >= steps:
            for config, times in columns:
                picked[config] += times / mean
        price_of = price_of * np.exp(-STEP_SIZE * np.clip(used / counts / mean - 1, -1, 1))
        price_of *= size / capacity / float((price_of * counts).sum())
    return {config: times / (steps - (steps + 1) // 2) for config, times in picked.items()} if steps > 1 else {}


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[dict[int, int], int]]:
    """(configuration as length -> copies, times); every count is used up exactly, and no worse than by best fit alone."""
    left = Counter({n: c for n, c in histogram.items() if c})
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece has to be of 1 to capacity tokens")
    out: list[tuple[dict[int, int], int]] = []

    def take(config: dict[int, int], times: int) -> None:
        if times > 0:
            out.append((config, times))
            for n, many in config.items():
                left[n] -= many * times

    take({capacity: 1}, left[capacity])
    lengths = np.array(sorted(n for n, c in left.items() if c), np.int64)
    if len(lengths):
        counts = np.array([left[int(n)] for n in lengths], np.float64)
        solved = fractional(lengths, counts, capacity, steps)
        for config, times in sorted(solved.items(), key=lambda x: (-x[1], x[0])):
            named = {int(lengths[i]): many for i, many in config}
            take(named, min([round(times), *(left[n] // many for n, many in named.items())]))
    out += best_fit({n: c for n, c in left.items() if c}, capacity)
    plain = best_fit({n: c for n, c in histogram.items() if c}, capacity)
    return min(out, plain, key=lambda p: sum(times for _, times in p))  # of equal ones the program's


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing, a whole run of equal pieces and equal bins at a time."""
    bins: dict[int, list[list]] = defaultdict(list)  # room left -> [configuration, how many]
    rooms: list[int] = []

    def put(room: int, config: Counter, times: int) -> None:
        if room not in bins or not bins[room]:
            insort(rooms, room)
        bins[room].append([config, times])

    for n in sorted(histogram, reverse=True):
        count = histogram[n]
        while count:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                many = capacity // n
                whole, rest = divmod(count, many)
                if whole:
                    put(capacity - many * n, Counter({n: many}), whole)
                if rest:
                    put(capacity - rest * n, Counter({n: rest}), 1)
                break
            room = rooms[at]
            config, times = bins[room].pop()
            if not bins[room]:
                rooms.pop(at)
            many = min(room // n, count)
            use = min(times, count // many)
            if use < times:
                put(room, config, times - use)
            put(room - many * n, config + Counter({n: many}), use)
            count -= use * many
    return [(dict(config), times) for kept in bins.values() for config, times in kept]


# --- pieces and places --------------------------------------------------------------


def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = PieceTokenizer(path)
        end = int(end_id).to_bytes(4, "little")
        for texts in batches:
            out = []
            for text in texts:
                ids = tokenizer.encode(text or "") + end
                parts = [ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity)]
                out.append(parts)
            yield pd.Series(out, index=texts.index, dtype=object)

    return cut


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's tokens, cut only where they exceed a sequence.

    ``ids`` are the token ids as little-endian unsigned 32-bit numbers.  Null and
    empty texts are one piece of the end id alone.
    """
    udf = F.pandas_udf(_pieces(tokenizer or tokenizer_path(), capacity, end_id), T.ArrayType(T.BinaryType())).asNondeterministic()
    rows = small_batches(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    cut = rows.select("doc_id", F.posexplode(udf("text")).alias("piece", "ids"))
    return cut.select(
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        (F.length("ids") / 4).cast("long").alias("length"),
        "ids",
    )


def _ranges(planned: list[tuple[dict[int, int], int]]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """For each length the ranges of ranks that a configuration takes, in order: first ranks, and rows of (first sequence, copies, offset)."""
    lows, rest = defaultdict(lambda: array("q")), defaultdict(lambda: array("q"))
    taken: Counter[int] = Counter()
    sequence = 0
    for config, times in planned:
        offset = 0
        for size in sorted(config, reverse=True):
            many = config[size]
            lows[size].append(taken[size])
            rest[size].extend((sequence, many, offset))
            taken[size] += many * times
            offset += many * size
        sequence += times
    return {n: np.frombuffer(x, np.int64) for n, x in lows.items()}, {n: np.frombuffer(x, np.int64).reshape(-1, 3) for n, x in rest.items()}


def pack(parts: DataFrame, *, capacity: int = CAPACITY, length: str = "length", ranked: int = RANKED, steps: int = STEPS) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; read three times, so pass a written table.

    Sequences hold at most ``capacity`` and have no gaps.  Equal rows are packed
    each on their own; an empty table gives an empty result.  Earlier columns
    ``sequence_id`` and ``offset`` are replaced, all others stay as they were.  A
    null length, or one that isn't from 1 to ``capacity``, is an error.
    """
    n, h, salt, before, rank, at = (fresh(parts, stem) for stem in ("n", "h", "salt", "before", "rank", "at"))
    # the salt and the order come from a row's contents, so that a task run again ranks alike
    simple = [F.col(f"`{c}`") for c, kind in parts.dtypes if not kind.startswith(("map", "variant"))]
    marked = parts.withColumn(n, F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0))).withColumn(h, F.xxhash64(*simple))
    total = {r[n]: r["c"] for r in marked.groupBy(n).agg(F.count("*").alias("c")).collect()}  # capacity rows at most
    planned = plan(total, capacity, steps)
    many = F.array(*[F.lit(-(-total.get(i, 1) // ranked)) for i in range(capacity + 1)])
    salted = marked.withColumn(salt, F.pmod(F.col(h), F.element_at(many, F.col(n).cast("int") + 1)).cast("int"))
    counts = salted.groupBy(n, salt).agg(F.count("*").alias("c"))
    earlier = W.Window.partitionBy(n).orderBy(salt).rowsBetween(W.Window.unboundedPreceding, -1)
    bases = counts.select(n, salt, F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias(before))  # capacity + pieces / ranked rows

    # At most capacity * steps / 2 configurations come from the program and 4 bins a length from the rest; a sequence
    # has at most 63 different lengths (1 + 2 + ... + 63 = 2016).  At 32 bytes each that is 140 MB, whatever the documents.
    shared = parts.sparkSession.sparkContext.broadcast(_ranges(planned))

    def place(sizes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        lows, rest = shared.value
        size, rank = sizes.to_numpy(np.int64), ranks.to_numpy(np.int64)
        seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            of = np.flatnonzero(size == s)
            range_of = np.searchsorted(lows[s], rank[of], "right") - 1
            first, copies, offset = rest[s][range_of].T
            within = rank[of] - lows[s][range_of]
            seq[of], off[of] = first + within // copies, offset + within % copies * s
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    udf = F.pandas_udf(place, "sequence_id long, offset long").asNondeterministic()
    order = W.Window.partitionBy(n, salt).orderBy(h)
    placed = salted.join(bases, [n, salt]).withColumn(rank, F.row_number().over(order) - 1 + F.col(before))
    kept = [F.col(f"`{c}`") for c in parts.columns if c not in ("sequence_id", "offset")]
    return placed.select(*kept, udf(n, rank).alias(at)).select(*kept, F.col(at)["sequence_id"].alias("sequence_id"), F.col(at)["offset"].alias("offset"))


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """The contract's columns: a row per piece with its sequence and its offset there.

    A null or empty text is one piece, the end id alone; repeated rows are packed
    each on their own; null ids stay null; an empty table gives an empty result.
    """
    cut = pieces(docs, **how)
    digest = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialize(digest, "pieces"), capacity=how.get("capacity", CAPACITY))
