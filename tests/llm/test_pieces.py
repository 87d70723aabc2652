"""Pieces of the SentencePiece vocabulary against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException

from archivolt.llm import pieces, queries

PARTS = ["▁", " ", "  ", "a", "the", "\n", "\r", "\t", "é", "é", "日本", "😀", "\x00", "Q", "ing", "123", ".", "...", "</s>", "<unk>", "<0x0A>", "　", " ", "ﬁ", "don't"]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.model_path())


def ids_of(model, text, end=True):
    return np.frombuffer(model.encode(text, end), "<i4").tolist()


def agenda_free(model, text):
    """Merging by a plain search of the best pair in each round, over the whole text uncut."""
    symbols = list("▁" + text.replace(" ", "▁")) if text else []
    while True:
        found = [(-model.library.get_score(model.ids[a + b]), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in model.ids]
        if not found:
            return [i for s in symbols for i in ([model.ids[s]] if s in model.ids else [model.bytes[b] for b in s.encode()])]
        i = min(found)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_ids_equal_the_librarys_and_a_plain_search(model):
    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14)))
        want = model.library.encode(text, add_eos=True)
        assert ids_of(model, text) == want and ids_of(model, text, end=False) == want[:-1]
        assert agenda_free(model, text) == want[:-1]
        assert model.library.decode(want) == text.replace("▁", " ")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(model, text):
    want = model.library.encode(text, add_eos=True)
    assert ids_of(model, text) == want


def test_decoding_of_any_lists(spark, model):
    draw = random.Random(2)
    rows = [None if i % 50 == 0 else [draw.choice([0, 1, 2, 259, 28705, draw.randrange(3, 259), draw.randrange(32000)]) for _ in range(draw.randint(0, 8))] for i in range(1000)]
    got = pieces.decode(spark.createDataFrame(list(enumerate(rows)), "id int, ids array<int>")).collect()
    assert {r["id"]: r["decoded"] for r in got} == {i: None if v is None else model.library.decode(v) for i, v in enumerate(rows)}


def test_long_runs_are_whole(model):
    for text in ("a" * 20_000, " " * 5_000, "ab▁" * 3_000, "é\n" * 4_000, "x" + " y" * 30_000):
        assert ids_of(model, text) == model.library.encode(text, add_eos=True)


def test_memory_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "MOST", 10)
    monkeypatch.setattr(model, "words", pieces._Memory())
    monkeypatch.setattr(model, "cuts", pieces._Memory())
    for i in range(200):
        assert ids_of(model, f"word{i} other{i}") == model.library.encode(f"word{i} other{i}", add_eos=True)
    assert len(model.words.new) <= 10 and len(model.cuts.new) <= 10


def test_query_against_library(spark, model):
    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = queries.op12_sentencepiece(spark, sf).collect()
    assert len(found) == len(rows)
    for r in found:
        want = model.library.encode(rows[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), sha(" ".join(map(str, want))), sha(model.library.decode(want)))


def test_nulls_repeats_and_other_columns(spark, model):
    frame = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (None, "é", None)], "doc_id long, text string, decoded_too string")
    coded = pieces.decode(pieces.encode(frame))
    assert coded.columns == [*frame.columns, "ids", "decoded"]
    rows = coded.collect()
    assert [(r["ids"] is None, r["decoded"]) for r in rows if r["doc_id"] == 1] == [(True, None)]
    assert [r["ids"] for r in rows if r["doc_id"] == 2] == [[2]]
    assert [r["ids"] for r in rows if r["doc_id"] == 3] == [model.library.encode("a b", add_eos=True)] * 2
    assert pieces.encode(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="already"):
        pieces.encode(frame, into="Text")


def test_ids_outside_the_vocabulary_are_an_error(spark):
    for bad in (-1, 99_999):
        with pytest.raises(PythonException):
            pieces.decode(spark.createDataFrame([([5, bad],)], "ids array<int>")).collect()
