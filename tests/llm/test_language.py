from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from archivolt.llm import language as L
from archivolt.llm import queries

WORDS = {"en": ["the", "and", "that", "with", "house", "water"], "de": ["der", "und", "nicht", "ein", "haus", "wasser"], "fr": ["le", "et", "que", "avec", "maison", "été"]}


def corpus(n=240):
    rnd = random.Random(1)
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(WORDS))
        rows.append((i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randrange(2, 60))), lang, "s"))
    return rows


def test_strides_count_the_same(monkeypatch):
    text = "Ünïcode wörds, 123 and  more – Ελληνικά тест " * 20
    want = L.grams(text)
    for n in (1, 2, 7, 64):
        monkeypatch.setattr(L, "_STRIDE", n)
        assert np.array_equal(L.grams(text), want)


@pytest.mark.parametrize("text", [None, "", "123 !?", "\n\t", "②"])
def test_texts_without_letters(text):
    assert L.grams(text) is None


def test_held_out_accuracy_and_unknown_texts(spark):
    rows = corpus() + [(1000, None, "en", "s"), (1001, "12 + 3", None, "s"), (1002, "the house", None, "s"), (None, "und nicht der", "de", "s")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, language string")
    out = L.predict_documents(frame).collect()
    assert len(out) == len(rows)
    true = {r[0]: r[2] for r in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] < 1000]
    assert held and sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.98 * len(held)
    by = {r["doc_id"]: r for r in out}
    assert by[1000]["lang_pred"] == by[1001]["lang_pred"] == "und" and by[1000]["rejected"]
    assert by[1002]["lang_pred"] == "en" and by[None]["lang_pred"] == "de" and by[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in out)


def test_foreign_texts_are_rejected_and_own_ones_kept(spark):
    rows = corpus() + [(2000 + i, "zxq jvk wpfz qqk xvz " * 20, None, "s") for i in range(3)] + [(3000, "  ", None, "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in L.keep_identified(frame).collect()}
    assert kept == {r[0] for r in rows if r[0] < 1000}


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "a text", None)], "doc_id long, text string, lang string")
    assert L.predict_documents(frame).first()["lang_pred"] == "und"
    assert L.predict_documents(frame.limit(0)).count() == 0


def test_copies_take_no_share_of_the_sample(spark):
    rows = [(f"{' '.join(WORDS['de'][i % 6 :])} {i} und{chr(97 + i % 26)}{chr(97 + i // 26)}", "de") for i in range(30) for _ in range(100)] + [(f"the house {chr(97 + i)} water", "en") for i in range(26)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    drawn = {(r["text"], r["lang"]) for r in L.sample(frame, text="text", lang="lang", per_language=40).collect()}
    assert drawn == set(rows)


def test_few_texts_set_no_high_floor():
    rows = {lang: np.stack([L.grams(" ".join(WORDS[lang][i : i + 4])) for i in range(2)]) for lang in sorted(WORDS)}
    other = np.stack([L.grams(" ".join(reversed(WORDS[lang][2:5]))) for lang in sorted(WORDS)])
    idf = np.ones(L.DIMENSIONS)
    model = L.join_languages([(lang, *L.fit_language(c, idf)) for lang, c in rows.items()], idf)
    best, _, rejected = model.predict(other)
    assert [model.languages[b] for b in best] == sorted(WORDS) and not rejected.any()
    assert (L.join_languages([("en", *L.fit_language(rows["en"][:1], idf))], idf).floors == 0).all()


def test_the_model_does_not_depend_on_the_order_of_rows(spark):
    frame = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string")
    one = L.train(frame.repartition(1).sortWithinPartitions("doc_id"), per_language=30)
    two = L.train(frame.repartition(5).sortWithinPartitions(L.F.desc("doc_id")), per_language=30)
    assert one.languages == two.languages and np.array_equal(one.centroids, two.centroids) and np.array_equal(one.floors, two.floors)
    drawn = L.sample(frame, text="text", lang="lang", per_language=30).groupBy("lang").count().collect()
    assert {r["count"] for r in drawn} == {30}


def test_many_languages_are_all_learned_or_refused(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 9, f"l{k:03}") for k in range(250)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(set(L.train(frame).languages)) == sorted(r[2] for r in rows)
    with pytest.raises(ValueError, match="most_languages"):
        L.train(frame, most_languages=249)


def test_clashing_columns_stay(spark):
    frame = spark.createDataFrame([(*r, "mine") for r in corpus(60)], "doc_id long, text string, lang string, source string, __language string")
    kept = L.keep_identified(frame)
    assert kept.columns == frame.columns and {r["__language"] for r in kept.collect()} == {"mine"}


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op3_language_id(spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(rows)
    right = [r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in out if r["held_out"] and rows[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert len(right) > 20 and sum(right) >= 0.97 * len(right)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in rows[r["doc_id"]]["text"] or ""))
