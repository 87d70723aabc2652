"""Full-text search: a query of words, phrases, OR and minus over stemmed words with their places.

A query is read once, on the driver, into alternatives of required and excluded
phrases, and becomes one column over ``hits``: the places of the query's own
stems in a row, the only thing that leaves the Arrow pass over the texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from archivolt.functions.stems import STEMMERS

# How much a hit counts by the class of its field, and what a sum of 1/n^2 without end comes to.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
BASEL = 1.64493406685
#: Hits of a stem that a rank reads; later ones add less than a thousandth.
RANKED = 256
HIT = "array<struct<lexeme:string,at:int,field:int>>"
#: Rows whose hits are held at once by a worker, whatever the size of an Arrow batch.
HELD = 200
_WORD = re.compile(r"[^\W_]+")
#: A word's stem where it is stated, or None, which leaves it to the language.
Dictionary = Callable[[str], str | None]


@dataclass(frozen=True)
class Phrase:
    """Stems with their distances from the first; one stem is a plain word."""

    words: tuple[tuple[str, int], ...]
    excluded: bool = False


#: Alternatives, each of phrases that all have to hold.
Query = tuple[tuple[Phrase, ...], ...]


def _stemmer(language: str, dictionary: Dictionary | None) -> Callable[[str], str]:
    """The language's stop words first, then the dictionary, then the language's stems."""
    stem = getattr(STEMMERS[language], "__wrapped__", STEMMERS[language])

    def chained(word: str) -> str:
        by_rule = stem(word)
        stated = dictionary(word) if by_rule and dictionary else None
        return by_rule if stated is None else stated

    return chained


@lru_cache(maxsize=4)
def _asked_stemmer(language: str, dictionary: Dictionary | None, asked: frozenset[str]) -> Callable[[str], str]:
    """A word's stem if it is asked, else nothing; remembered by the worker, in one place for all fields and tasks."""
    stem = _stemmer(language, dictionary)
    return lru_cache(maxsize=100_000)(lambda word: s if (s := stem(word)) in asked else "")


def parse(text: str, language: str, dictionary: Dictionary | None = None) -> Query:
    """Words and quoted phrases have to hold together; ``or`` parts alternatives, ``-`` excludes what follows it.

    Stop words ask for nothing, inside a phrase they keep their place; a word with
    signs in it is a phrase of its parts; other signs are passed over; an unclosed
    quote ends with the text.  A query without words finds nothing.
    """
    alternatives, stem = [[]], _stemmer(language, dictionary)
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text):
        if plain.lower() == "or" and not minus:
            alternatives.append([])
            continue
        stems = [stem(w) for w in _WORD.findall((quoted or plain).lower())]
        places = [i for i, s in enumerate(stems) if s]
        if places:
            alternatives[-1].append(Phrase(tuple((stems[i], i - places[0]) for i in places), bool(minus)))
    return tuple(tuple(a) for a in alternatives if a)


def lexemes(query: Query) -> list[str]:
    """The stems of a query, each once, in order."""
    return sorted({word for alternative in query for phrase in alternative for word, _ in phrase.words})


def hits(fields: list[tuple[Column, str]], wanted: list[str], dictionary: Dictionary | None = None) -> Column:
    """Where the wanted stems stand: (lexeme, at, field), in order; ``at`` counts words over all fields.

    ``fields`` are (text, language).  A field starts behind the one before it, a
    word further, so no phrase crosses; null texts hold no words; texts are read whole.
    Words whose stem is stated otherwise go by the dictionary, as they do in ``parse``.
    """
    languages, asked = [language for _, language in fields], frozenset(wanted)

    def found(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        stemmers = [_asked_stemmer(language, dictionary, asked) for language in languages]
        for batch in batches:
            texts = batch if isinstance(batch, tuple) else (batch,)  # one column comes by itself
            rows = zip(*texts)
            while held := list(islice(rows, HELD)):
                out = []
                for row in held:
                    places, start = [], 0
                    for field, (text, stem) in enumerate(zip(row, stemmers)):
                        words = _WORD.findall((text or "").lower())
                        places += [{"lexeme": s, "at": start + i, "field": field} for i, s in enumerate(map(stem, words)) if s]
                        start += len(words) + 1
                    out.append(places)
                yield pd.Series(out, dtype=object)
            if not len(texts[0]):
                yield pd.Series([], dtype=object)

    return F.pandas_udf(found, HIT).asNondeterministic()(*[text for text, _ in fields])


def _holds(places: Column, phrase: Phrase) -> Column:
    (first, _), *rest = phrase.words
    of = lambda word: F.transform(F.filter(places, lambda x: x["lexeme"] == word), lambda x: x["at"])
    if not rest:
        return F.exists(places, lambda x: x["lexeme"] == first)
    beside = lambda at: reduce(Column.__and__, [F.array_contains(of(word), at + distance) for word, distance in rest])
    return F.exists(of(first), beside)


def matches(places: Column, query: Query) -> Column:
    """Whether a row's hits satisfy the query."""
    alternatives = []
    for alternative in query:
        parts = [~_holds(places, p) if p.excluded else _holds(places, p) for p in alternative]
        alternatives.append(reduce(Column.__and__, parts))
    return reduce(Column.__or__, alternatives, F.lit(False))


def rank(places: Column, query: Query, classes: list[str]) -> Column:
    """How well a row answers: the mean over the query's stems of what their hits count.

    The n-th hit of a stem counts its field's weight over n^2, but the best of
    them counts whole; ``classes`` names each field's weight.  Excluded stems count
    like others, and a stem without hits counts nothing.
    """
    weights = F.array(*[F.lit(WEIGHTS[c]) for c in classes])

    def of(word: str) -> Column:
        counts = F.transform(F.slice(F.filter(places, lambda x: x["lexeme"] == word), 1, RANKED), lambda x: F.get(weights, x["field"]))
        damped = F.aggregate(F.transform(counts, lambda w, i: w / ((i + 1) * (i + 1))), F.lit(0.0), lambda a, b: a + b)
        best = F.array_max(counts)
        first = F.array_position(counts, best)
        return F.coalesce((best + damped - best / (first * first)) / BASEL, F.lit(0.0))

    words = lexemes(query)
    return sum((of(w) for w in words), F.lit(0.0)) / max(1, len(words))


def search(texts: list[tuple[Column, str, str]], query: str, languages: tuple[str, ...] = ("swedish", "english")) -> tuple[Column, Callable[[Column], tuple[Column, Column]]]:
    """(hits, judge) of a query read in several languages at once, an answer in either being one.

    ``texts`` are (text, language, class); ``judge(column of hits)`` is (matches, rank).
    """
    asked = tuple(a for language in languages for a in parse(query, language))
    classes = [c for _, _, c in texts]
    return hits([(t, language) for t, language, _ in texts], lexemes(asked)), lambda places: (matches(places, asked), rank(places, asked, classes))


def best(ranked: DataFrame, most: int, id_: str = "doc_id") -> DataFrame:
    """(id, place): the ``most`` rows of the highest rank, ties by id; a top-k, so only its rows meet in one task."""
    top = ranked.orderBy(F.desc("rank"), id_).limit(most)
    return top.select(id_, F.row_number().over(W.Window.orderBy(F.desc("rank"), id_)).alias("place"))
