"""Language identification by nearest centroids of normalised TF-IDF n-gram vectors.

A text's letter trigrams (with word borders) are counted into ``DIMENSIONS``
hashed features, damped, weighted by inverse document frequency and normalised.
Every language has several centroids from spherical k-means over its labelled
rows; a text takes the language of the most similar one.  It is rejected when
that similarity is lower than texts of its length have with their own language.

The model is fitted on a bounded sample of labelled rows: the ``PER_LANGUAGE``
different texts of each language with the smallest hashes, the same whatever the
order of the rows.  A task clusters the sample of one language; only document
frequencies and finished centroids reach the driver.  Prediction is one pass over
all rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from archivolt.llm.common import fresh, materialize, small_batches

DIMENSIONS = 4096
#: Labelled texts of a language that the model is fitted on, at most.
PER_LANGUAGE = 400
#: Languages that a model may have before training refuses (64 kB of centroids each are broadcast); none is left out.
MOST_LANGUAGES = 2000
CENTROIDS = 4
ROUNDS = 12
#: A text is rejected below this share of the lowest similarity seen for its length.
SLACK = 0.6
#: Bounds of the length classes, in n-grams.
CLASSES = (8, 16, 32, 64, 128, 256, 1024)
UNKNOWN = "und"
#: Characters of a text that are counted at a time.
_STRIDE = 1 << 20


def grams(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter trigrams over the whole text; None without a letter."""
    if not text:
        return None
    out = np.zeros(DIMENSIONS, np.int64)
    carry = np.zeros(0, np.uint64)
    letters = False
    for at in range(0, len(text), _STRIDE):
        part = text[at : at + _STRIDE].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        solid = _is_letter(codes, part)
        letters = letters or bool(solid.any())
        codes = np.where(solid, codes, 32).astype(np.uint64)
        if not at:
            codes = np.concatenate((np.array([32], np.uint64), codes))
        if at + _STRIDE >= len(text):
            codes = np.concatenate((codes, np.array([32], np.uint64)))
        codes = np.concatenate((carry, codes))
        gap = codes == 32
        codes = codes[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]  # one border between words
        if len(codes) >= 3:
            mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
            out += np.bincount(((mixed * np.uint64(0x27D4EB2F)) >> np.uint64(13)) % np.uint64(DIMENSIONS), minlength=DIMENSIONS)
        carry = codes[-2:]
    return out if letters else None


def _is_letter(codes: np.ndarray, part: str) -> np.ndarray:
    """Where a character is a letter; ASCII and Latin by range, others one by one."""
    low = (codes >= 97) & (codes <= 122)
    latin = (codes >= 0xC0) & (codes < 0x250) & (codes != 0xD7) & (codes != 0xF7) | (codes == 0xAA) | (codes == 0xB5) | (codes == 0xBA)
    out = low | latin
    for i in np.flatnonzero(codes >= 0x250).tolist():
        out[i] = part[i].isalpha()
    return out


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped, weighted and normalised rows."""
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray  # of each length class

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid's place, the similarity, and whether it is too low."""
        like = unit(counts, self.idf) @ self.centroids.T
        best = like.argmax(axis=1)
        score = np.clip(like[np.arange(len(like)), best], 0, 1).astype(np.float64)
        return best, score, score < self.floors[np.digitize(counts.sum(axis=1), CLASSES)]


def _clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from evenly spread first centres; fixed input gives fixed centroids.

    With every row's similarity to the nearest centroid, its own one without the
    row; -1 for a row alone.
    """
    k = min(k, len(x))
    near = x @ x.mean(axis=0)
    centres = x[np.argsort(near, kind="stable")[np.linspace(0, len(x) - 1, k).astype(int)]]
    for _ in range(ROUNDS):
        owner = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[owner == i].sum(axis=0) if (owner == i).any() else centres[i] for i in range(k)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    like, rows = x @ centres.T, np.arange(len(x))
    alone = np.bincount(owner, minlength=k)[owner] == 1
    rest = sums[owner] - x
    left = (x * rest).sum(axis=1) / np.maximum(np.linalg.norm(rest, axis=1), 1e-12)
    like[rows, owner] = np.where(alone, -1, left)
    return centres.astype(np.float32), like.max(axis=1)


def fit_language(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids of a language's rows, and the lowest similarity of each length class (2: none seen)."""
    counts = counts[np.lexsort(counts.T[::-1])] if len(counts) > 1 else counts  # whatever the order of the rows
    made, like = _clusters(unit(counts, idf), CENTROIDS)
    of, lows = np.digitize(counts.sum(axis=1), CLASSES), np.full(len(CLASSES) + 1, 2.0)
    seen = like > -1  # a text alone tells nothing of others
    np.minimum.at(lows, of[seen], like[seen])
    return made, lows


def join_languages(fitted: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """The model of (language, centroids, lows), whatever their order."""
    fitted = sorted(fitted, key=lambda x: x[0])
    floors, low = [], 0.0
    for seen in np.min([x[2] for x in fitted], axis=0):  # longer texts are no less similar: a class without rows takes the one before
        low = SLACK * float(seen) if seen < 2 else low
        floors.append(low)
    return Model([name for name, c, _ in fitted for _ in c], np.concatenate([x[1] for x in fitted]), idf, np.array(floors))


def sample(docs: DataFrame, *, text: str, lang: str, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text): the ``per_language`` different texts of each language with the smallest hashes.

    Hashes are drawn from first, by a share that leaves about twice as many as
    are needed, so that no language is sorted whole.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang is not null and text is not null")
    hashed = F.xxhash64("text", F.lit(11))
    texts = materialize(rows.select("lang", hashed.alias("h")).distinct(), "texts")
    # written, so that its known size lets the draw come before the shuffle by language
    sizes = materialize(texts.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
    share = F.lit(2.0 * per_language) + F.lit(20.0)  # of few texts all are drawn, however the hashes fall
    drawn = texts.join(sizes, "lang").where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < share / F.col("n"))
    place = W.Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    chosen = drawn.withColumn("place", F.row_number().over(place)).where(F.col("place") <= per_language).select("lang", "h")
    chosen = materialize(chosen, "chosen")  # so that the join knows how small it is
    return rows.withColumn("h", hashed).join(chosen, ["lang", "h"], "left_semi").select("lang", "text").dropDuplicates(["lang", "text"])


def _count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts as sparse bytes, so that a row stays small."""
    for batch in batches:
        out = []
        for name, text in zip(batch["lang"], batch["text"], strict=True):
            counts = grams(text)
            if counts is not None:
                at = np.flatnonzero(counts)
                out.append((name, at.tolist(), at.astype("<u2").tobytes(), counts[at].astype("<u4").tobytes()))
        yield pd.DataFrame(out, columns=["lang", "of", "at", "n"])


def _fitted(idf: np.ndarray):
    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((len(rows), DIMENSIONS), np.int32)
        for i, (at, n) in enumerate(zip(rows["at"], rows["n"], strict=True)):
            counts[i, np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
        made, lows = fit_language(counts, idf)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "centroids": [made.tobytes()], "lows": [lows.tolist()]})

    return fitted


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """The model of the labelled rows of ``docs``; None if there are none.

    More than ``most_languages`` labels raise an error: none is left out silently.
    """
    drawn = sample(docs, text=text, lang=lang, per_language=per_language)
    counted = materialize(small_batches(drawn).mapInPandas(_count_rows, "lang string, of array<int>, at binary, n binary"), "counts")
    size = counted.agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs")).first()
    if not size["n"]:
        return None
    if size["langs"] > most_languages:
        raise ValueError(f"{size['langs']} languages are labelled; most_languages is {most_languages}")
    frequency = np.zeros(DIMENSIONS, np.int64)
    for r in counted.select(F.explode("of").alias("at")).groupBy("at").count().collect():  # DIMENSIONS rows at most
        frequency[r["at"]] = r["count"]
    idf = np.log((1 + size["n"]) / (1 + frequency)) + 1
    made = counted.select("lang", "at", "n").groupBy("lang").applyInPandas(_fitted(idf), "lang string, centroids binary, lows array<double>")  # per_language rows a group
    return join_languages([(r["lang"], np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMENSIONS), np.array(r["lows"])) for r in made.collect()], idf)  # a row a language


def _predictor(shared: Broadcast):
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model: Model | None = shared.value
        for texts in batches:
            names = np.full(len(texts), UNKNOWN, dtype=object)
            score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
            counted = [grams(t) for t in texts]
            for at in range(0, len(texts), 256):
                of = [i for i in range(at, min(at + 256, len(texts))) if counted[i] is not None]
                if of and model is not None:
                    best, score[of], rejected[of] = model.predict(np.stack([counted[i] for i in of]))
                    names[of] = [model.languages[b] for b in best]
            yield pd.DataFrame({"lang_pred": names, "score": score, "rejected": rejected})

    return predict


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with ``into``: lang_pred, score from 0 to 1, rejected.

    Texts that are null or have no letter are ``und``, score 0, rejected; so is
    every text where there was nothing to learn from.  Equal similarities go to
    the first language by name.  Only the text is read for a prediction.
    An empty table stays empty; a column that is already named like ``into`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids of MOST_LANGUAGES languages at most
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    udf = F.pandas_udf(_predictor(shared), kind).asNondeterministic()
    return small_batches(docs).withColumn(into, udf(F.col(f"`{text}`")))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_identified(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the texts that are rejected; columns as they were.

    Null texts and texts without a letter go, as does every text if no row has a
    label to learn from; equal rows fare alike; an empty table stays empty.
    """
    mark = fresh(docs, "language")
    model = train(docs.where(~held_out(F.col(f"`{doc_id}`"))), text=text, lang=lang)
    marked = identify(docs, model, text=text, into=mark)
    return marked.where(~F.col(mark)["rejected"]).select([F.col(f"`{c}`") for c in docs.columns])


def predict_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs``; null ids are learned from and not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")
