"""Corpus work: copies across sources, phrase mining, screening reports."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from archivolt.functions import text as X
from archivolt.operators.graph import connected, removed, written

# Words of a shingle, and the Jaccard similarity of near copies as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Texts that shingles are counted in, counters of them and how many go together, unjoined texts that make a shingle
#: crowded, bits of a set's parities, remembered words, sets held while pairs are compared; none of them changes a result.
SAMPLED, COUNTERS, BLOCK, CROWDED, PARITIES, REMEMBERED, HELD = 1 << 20, 1 << 23, 1 << 13, 64, 512, 400_000, 64


def exact_copies(samples: DataFrame) -> DataFrame:
    """``samples`` (id, text) with ``dup_of``: the smallest id with the same normalised text, null for the first."""
    keyed = samples.withColumn("__key", F.sha2(X.normalized(F.col("text")), 256))
    first = keyed.groupBy("__key").agg(F.min("id").alias("__first"))
    return keyed.join(first, "__key").withColumn("dup_of", F.when(F.col("__first") < F.col("id"), F.col("__first"))).drop("__key", "__first")


def _mixed(h: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers mixed, one to one."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class _Words(dict):
    """A 64-bit hash by word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_WORDS = _Words()


def _shingles(text: str) -> np.ndarray:
    """The 64-bit hashes of a normalised text's word shingles, each once, in order; fewer words are one shingle."""
    words = text.split(" ")
    hashed = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    made = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        made = made * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + len(made)]
    return np.unique(_mixed(made).view(np.int64))


@lru_cache(maxsize=HELD)
def _held(text: str) -> np.ndarray:
    """The shingles of a text; one that many pairs share is read once."""
    return _shingles(X.normal(text))


def shingle_hashes(norm: Column) -> Column:
    """The set of shingle hashes of a normalised text."""

    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([_shingles(t) for t in texts], index=texts.index, dtype=object)

    return F.pandas_udf(hashed, "array<long>").asNondeterministic()(norm)


def _counter(h: np.ndarray) -> np.ndarray:
    """The counter of each hash."""
    return (h.view(np.uint64) % np.uint64(COUNTERS)).astype(np.int64)


def _counted(texts: DataFrame) -> np.ndarray:
    """COUNTERS 16-bit counts of the shingles of about SAMPLED texts, those of one counter together.

    A task counts its texts and hands on packed blocks, so no shingle is shuffled.
    """
    share = min(1.0, SAMPLED / max(1, texts.count()))
    drawn = texts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for t in batch["text"]:
                np.add.at(found, _counter(_shingles(X.normal(t))), 1)
        blocks = [(i // BLOCK, zlib.compress(found[i : i + BLOCK].tobytes(), 1)) for i in range(0, COUNTERS, BLOCK) if found[i : i + BLOCK].any()]
        yield pd.DataFrame(blocks, columns=["block", "n"])

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(n), np.uint32).astype(np.int64) for n in rows["n"])
        return pd.DataFrame({"block": [key[0]], "n": [np.minimum(total, 65_535).astype(np.uint16).tobytes()]})

    parts = drawn.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(counted, "block int, n binary")
    made = np.zeros((COUNTERS // BLOCK, BLOCK), np.uint16)
    for row in parts.groupBy("block").applyInPandas(added, "block int, n binary").collect():  # at most 16 MB, whatever the texts
        made[row["block"]] = np.frombuffer(row["n"], np.uint16)
    return made.reshape(-1)


def _in_order(h: np.ndarray, keys: np.ndarray, counts: np.ndarray, late: np.ndarray | None = None) -> np.ndarray:
    """Hashes by how frequent they are, the ``late`` ones behind all others: one order of all hashes."""
    weight = np.zeros(len(h), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        weight = np.where(keys[at] == h, counts[at], 0)
    return h[np.lexsort((h, weight, np.isin(h, late)) if late is not None else (h, weight))]


def _prefix(n: int) -> int:
    """Of two sets that share SIMILAR of their union, these first ones of either, in one order, have a hash in common."""
    return n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1


def _parities(h: np.ndarray) -> bytes:
    """A bit for each of PARITIES residues: whether an odd number of hashes falls there.  Two sets differ in no fewer hashes than bits."""
    return np.packbits(np.bincount((_mixed(h.view(np.uint64)) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1).tobytes()


def _outline(shared) -> Column:
    """Of a text: the digest of its normalised form, the size of its set, the set's prefix, and its parities."""

    def outlined(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in map(X.normal, texts):
            h = _shingles(t)
            rows.append((hashlib.sha256(t.encode()).digest(), len(h), _in_order(h, h, shared.value[_counter(h)])[: _prefix(len(h))], _parities(h)))
        return pd.DataFrame(rows, columns=["key", "n", "p", "bits"])

    return F.pandas_udf(outlined, "struct<key:binary,n:int,p:array<long>,bits:binary>").asNondeterministic()


def _differ(x: Column, y: Column) -> Column:
    """Bits in which two hexadecimal-coded rows of parities differ."""
    word = lambda c, i: F.conv(F.substring(c, 16 * i + 1, 16), 16, -10).cast("long")
    return sum((F.bit_count(word(x, i).bitwiseXOR(word(y, i))) for i in range(PARITIES // 64)), F.lit(0))


def _may(n: str, m: str, i: str, j: str) -> Column:
    """Whether sets of n and m hashes that meet in places i and j of theirs can be similar: by their sizes, and by what can be common before and behind."""
    n, m, i, j = map(F.col, (n, m, i, j))
    most = F.least(i, j) + 1 + F.least(n - i, m - j) - 1
    return (F.least(n, m) * SIMILAR[1] >= F.greatest(n, m) * SIMILAR[0]) & (most * (SIMILAR[0] + SIMILAR[1]) >= (n + m) * SIMILAR[0])


def _similar(pairs: DataFrame, outlines: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets reach the threshold; parities sort most out before texts are read."""
    side = lambda name: outlines.select(F.col("id").alias(name), F.col("n").alias(f"{name}_n"), F.hex("bits").alias(f"{name}_bits"))
    known = pairs.join(side("a"), "a").join(side("b"), "b")
    # apart <= (1 - s) / (1 + s) of both sizes together
    near = (_differ(F.col("a_bits"), F.col("b_bits")) * (SIMILAR[0] + SIMILAR[1])) <= (F.col("a_n") + F.col("b_n")) * (SIMILAR[1] - SIMILAR[0])
    left = written(known.where(near).select("a", "b"), "candidates")
    text = lambda name, c: texts.select(F.col("id").alias(name), F.col("text").alias(c))
    both = left.join(text("a", "x"), "a").join(text("b", "y"), "b")

    def reach(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s: str, t: str) -> bool:
            s, t = _held(s), _held(t)
            common = len(np.intersect1d(s, t, assume_unique=True))
            return common * SIMILAR[1] >= (len(s) + len(t) - common) * SIMILAR[0]

        return pd.Series([one(s, t) for s, t in zip(x, y)], index=x.index, dtype=bool)

    met = both.where(F.pandas_udf(reach, "boolean").asNondeterministic()(F.coalesce("x", F.lit("")), F.coalesce("y", F.lit("")))).select("a", "b")
    kept = written(met, "links")
    removed(left)
    return kept


def _in_batches(spark: SparkSession, rows: int, work: Callable[[], DataFrame]) -> DataFrame:
    """``work``, which writes what it computes, with Arrow batches of so many rows: texts can be long.  The setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        return work()
    finally:
        spark.conf.set(name, before)


def near_copies(samples: DataFrame) -> DataFrame:
    """(id, dup_of): texts that links of Jaccard SIMILAR or more over word shingles join to an earlier one; the earliest such one.

    Equal normalised texts are one class; null and empty texts are equal; an id is
    unique.  Candidates share a hash of their prefixes, with sizes and places that
    allow the threshold, so none is lost.  First every class meets the earliest that
    shares a hash of it, which joins most copies by a row each; then all others
    meet whose ends aren't joined yet.  A passage of many texts would
    bring all of these together: hashes that more than CROWDED unjoined classes
    share go to the end of the order, with all that are as frequent in the same texts,
    and only texts that have such in their prefixes get new ones, until those left
    bring at most as many pairs a row as hashes that aren't crowded may.
    """
    return _in_batches(samples.sparkSession, 500, lambda: _near_copies(samples.select("id", "text")))


def _near_copies(texts: DataFrame) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(_counted(texts))  # COUNTERS numbers of 16 bits
    outline = texts.select("id", _outline(shared)(F.coalesce("text", F.lit(""))).alias("o")).select("id", "o.*")
    whole = written(outline, "outlines")
    classes = whole.groupBy("key").agg(F.min("id").alias("id"))
    outlines = whole.join(classes.select("id"), "id", "left_semi")
    every = outlines.select(F.posexplode("p").alias("i", "h"), "id", "n")
    met = every.withColumn("k", F.count("*").over(W.Window.partitionBy("h"))).where("k > 1").drop("k")
    prefixes = written(met, "prefixes")

    heads = prefixes.groupBy("h").agg(F.min(F.struct("id", "n", "i")).alias("head")).select("h", "head.*").toDF("h", "a", "m", "j")
    first = prefixes.join(heads, "h").where((F.col("a") < F.col("id")) & _may("n", "m", "i", "j")).select("a", F.col("id").alias("b")).distinct()
    links = _similar(first, outlines, texts)
    root = connected(links)

    late = None
    while True:
        rooted = prefixes.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
        meeting = rooted.groupBy("h", "root").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("roots")).where("roots > 1")
        crowded = meeting.where(F.col("roots") > CROWDED)
        if late is not None:
            crowded = crowded.join(late, "h", "left_anti")
        crowded = written(crowded, "crowded")
        most, squares = crowded.agg(F.coalesce(F.max("roots"), F.lit(0)), F.coalesce(F.sum(F.col("roots") * F.col("roots")), F.lit(0))).first()
        if most <= CROWDED * CROWDED // 4 and squares <= CROWDED * prefixes.count():
            break
        # a passage is many hashes: all that are as frequent in the texts that meet move at once, and with them every text that has one in its prefix
        met = written(prefixes.join(crowded, "h", "left_semi").select("id").distinct(), "met")
        hashes = texts.join(met, "id", "left_semi").select(F.explode(shingle_hashes(X.normalized(F.col("text")))).alias("h"))
        frequent = hashes.groupBy("h").count().where(F.col("count") > CROWDED).select("h")
        earlier, late = late, written(frequent if late is None else frequent.unionByName(late).distinct(), "late")
        touched = written(every.join(late, "h", "left_semi").select("id").distinct(), "touched")
        again = written(_later(texts.join(touched, "id", "left_semi"), late, shared), "again")
        others = every.join(touched, "id", "left_anti")
        rest = others.join(prefixes.select("h").unionByName(again.select("h")).distinct(), "h", "left_semi")
        before, prefixes = prefixes, written(rest.unionByName(again), "prefixes")
        removed(before, again, touched, met, crowded, *([] if earlier is None else [earlier]))
    mine = written(rooted.join(meeting.select("h"), "h"), "meeting")
    other = mine.select("h", F.col("id").alias("a"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("top"))
    pairs = mine.join(other, "h").where((F.col("a") < F.col("id")) & (F.col("root") != F.col("top")) & _may("n", "m", "i", "j")).select("a", F.col("id").alias("b")).distinct()
    found = _similar(pairs, outlines, texts)
    root = connected(links.unionByName(found))
    removed(mine, prefixes)
    named = classes.join(root, "id", "left").select("key", F.coalesce("root", "id").alias("dup_of"))
    return whole.select("id", "key").join(named, "key").where("dup_of < id").select("id", "dup_of")


def _later(texts: DataFrame, late: DataFrame, shared) -> DataFrame:
    """(i, h, id, n): prefixes of texts in the order that puts the ``late`` hashes last."""
    sets = texts.select("id", shingle_hashes(X.normalized(F.col("text"))).alias("sh"))
    among = sets.select("id", F.explode("sh").alias("h")).join(late, "h", "left_semi").groupBy("id").agg(F.collect_list("h").alias("late"))

    def first(found: pd.Series, behind: pd.Series) -> pd.Series:
        out = [_in_order(h, h, shared.value[_counter(h)], b)[: _prefix(len(h))] for h, b in zip((np.asarray(x, np.int64) for x in found), (np.asarray(x if x is not None else [], np.int64) for x in behind))]
        return pd.Series(out, index=found.index, dtype=object)

    known = sets.join(among, "id", "left").select("id", F.size("sh").alias("n"), F.pandas_udf(first, "array<long>").asNondeterministic()("sh", "late").alias("p"))
    return known.select(F.posexplode("p").alias("i", "h"), "id", "n")


def mine_phrases(samples: DataFrame, *, n: int = 3, least: int = 5, most_share: float = 0.8) -> DataFrame:
    """(gram, support, sources, top_share): phrases of target samples that no ordinary sample has.

    ``samples``: id, source, target (boolean), text.  A phrase needs support, two
    sources, and no source may hold more than ``most_share`` of it.
    """
    words = samples.select("id", "source", "target", X.tokens(F.col("text")).alias("w")).where(F.size("w") >= n)
    grams = words.select("id", "source", "target", F.explode(X.shingles(F.col("w"), n)).alias("gram"))
    per_source = grams.groupBy("gram", "source").agg(F.count_if("target").alias("hit"), F.count_if(~F.col("target")).alias("plain"))
    made = per_source.groupBy("gram").agg(F.sum("hit").alias("support"), F.sum("plain").alias("__plain"), F.count_if(F.col("hit") > 0).alias("sources"), F.max("hit").alias("__top"))
    kept = made.where((F.col("__plain") == 0) & (F.col("support") >= least) & (F.col("sources") >= 2))
    return kept.withColumn("top_share", F.col("__top") / F.col("support")).where(F.col("top_share") <= most_share).drop("__plain", "__top")


def held_back(id_: Column, share: float = 0.3) -> Column:
    """Whether a row is kept for measuring: so large a share, by a digest of its id."""
    return F.conv(F.substring(F.sha2(id_.cast("string"), 256), 1, 8), 16, 10).cast("long") < F.lit(int(share * 2**32))


def rule_candidates(samples: DataFrame, *, n: int = 3, least: int = 5, most_share: float = 0.8, most: int = 20) -> DataFrame:
    """(place, gram, support, gain, held_attacks, held_ordinary): phrases chosen one by one by the target samples that they newly cover.

    Phrases are mined in the samples that aren't held back.  A round takes the
    phrase of the largest gain (ties: the shorter, then by letters) and leaves out
    the samples it covers; it ends at ``most`` phrases or below ``least`` new ones.
    The chosen phrases are then counted in the held-back samples.
    """
    held = held_back(F.col("id"))
    pool = written(mine_phrases(samples.where(~held), n=n, least=least, most_share=most_share).select("gram", "support"), "pool")
    words = samples.select("id", "target", X.tokens(F.col("text")).alias("w")).where(F.size("w") >= n)
    grams = words.select("id", "target", held.alias("held"), F.explode(X.shingles(F.col("w"), n)).alias("gram"))
    left = written(grams.where("target and not held").select("id", "gram").join(pool.select("gram"), "gram", "left_semi"), "covers")
    chosen = []
    while len(chosen) < most:
        best = left.groupBy("gram").agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), F.length("gram"), "gram").first()
        if best is None or best["gain"] < least:
            break
        chosen.append((len(chosen) + 1, best["gram"], best["gain"]))
        left = written(left.join(left.where(F.col("gram") == best["gram"]).select("id"), "id", "left_anti"), "covers")
    named = samples.sparkSession.createDataFrame(chosen, "place int, gram string, gain long")
    seen = grams.where("held").join(named.select("gram"), "gram", "left_semi").groupBy("gram").agg(F.count_if("target").alias("attacks"), F.count_if(~F.col("target")).alias("ordinary"))
    told = named.join(pool, "gram").join(seen, "gram", "left")
    return told.select("place", "gram", "support", "gain", F.coalesce("attacks", F.lit(0)).alias("held_attacks"), F.coalesce("ordinary", F.lit(0)).alias("held_ordinary"))


def screening_report(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, attacks, caught, ordinary, alarms) of results (attack, flagged)."""
    return results.groupBy(*by).agg(
        F.count_if("attack").alias("attacks"),
        F.count_if(F.col("attack") & F.col("flagged")).alias("caught"),
        F.count_if(~F.col("attack")).alias("ordinary"),
        F.count_if(~F.col("attack") & F.col("flagged")).alias("alarms"),
    )


def chunks(texts: DataFrame, lines: int = 60) -> DataFrame:
    """(id, chunk, text): texts in pieces of so many lines."""
    split = texts.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    placed = split.groupBy("id", F.floor(F.col("pos") / lines).cast("long").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    return placed.select("id", "chunk", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))
