from __future__ import annotations

import hashlib
import random
import re

import pytest

from archivolt.llm import decontaminate as D
from archivolt.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    words = fold(text)
    hit, found = set(), set()
    for name, item in items:
        w = fold(item)
        if not w:
            continue
        size = min(window, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in wins:
                hit.update(range(i, i + size))
                if name is not None:
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


def cases(seed):
    rnd = random.Random(seed)
    pick = lambda n: [rnd.choice("abcdé") for _ in range(n)]
    items = [(i, " ".join(pick(rnd.choice([1, 3, 4, 5, 9, 14]))) if i % 7 else None) for i in range(12)]
    items = [(i, None if t is not None and len(t) < 5 else t) for i, t in items] + [(99, "... !"), (None, "é é a a b")]
    docs = [(k, "".join(w + rnd.choice([" ", ", ", "\n", " "]) for w in pick(rnd.randrange(0, 80)))) for k in range(60)]
    return [*docs, (60, None), (61, ""), (62, "A a B! " * 300)], items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scan_against_brute_force(seed):
    docs, items = cases(seed)
    a = D.build([([] if i is None else [str(i)], D.words_of(t)) for i, t in items], 4)
    for _, text in docs:
        words = D.words_of(text)
        hits, found, _ = D.scan(words, a, 4)
        assert (len(words), sum(e - s for s, e in hits), sorted(found)) == brute(text, items, 4)


@pytest.mark.parametrize("block_words", [1_000_000, 5])
def test_operator_in_one_block_and_in_many(spark, block_words):
    docs, items = cases(4)
    rows = spark.createDataFrame([(k, t, 1.5) for k, t in docs], "doc_id long, text string, n_words double")
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in D.with_digest(D.find_contamination(rows, frame, window=4, block_words=block_words)).collect()}
    assert len(got) == len(docs)
    for k, text in docs:
        n, hit, found = brute(text, items, 4)
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_spans_are_cut_and_clean_documents_stay(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, f"Some clean words, {item.upper()}! and more that is fine here today for all."), (2, "nothing at all"), (3, item), (4, None), (5, "")]
    out = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, item)], "item_id long, text string"))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == ["doc_id", "text"]
    assert got == {1: "Some clean words, ! and more that is fine here today for all.", 2: "nothing at all", 4: None, 5: ""}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.with_digest(D.find_contamination(docs, items)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.with_digest(D.find_contamination(one, items)).first()["n_words"] == 2


def test_copies_of_items_and_long_ones_and_long_documents(spark):
    rnd = random.Random(6)
    long = " ".join(rnd.choice("abcdefgh") for _ in range(3000))
    items = [(i, long) for i in range(40)] + [(50, "x y z " * 40), (51, "q r s t u")]
    docs = [(1, "m n " * 100_000 + long[1000:1200] + " o p"), (2, "a b c"), (3, "z x y z x y z x y z x y"), (4, "q R s! T u")]
    rows = spark.createDataFrame([(k, t, "mine") for k, t in docs], "doc_id long, text string, __contamination string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in D.with_digest(D.find_contamination(rows, frame, block_words=100)).collect()}
    for k, text in docs:
        n, hit, found = brute(text, [(f"{i}", t) for i, t in items])
        assert (got[k]["n_words"], got[k]["n_hit"], got[k]["n_items"]) == (n, hit, len(found))
        assert got[k]["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    clean = D.decontaminate(rows, frame)
    assert clean.columns == rows.columns
    assert {r["doc_id"]: r["__contamination"] for r in clean.collect()} == {1: "mine", 2: "mine"}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op8_benchmark_decontamination(spark, sf).collect()}
    assert got.keys() == texts.keys()
    windows: dict[tuple, set[str]] = {}
    for name, item in items:
        w = fold(item)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(name))
    sizes = {len(w) for w in windows}
    for k, text in texts.items():
        words, hit, found = fold(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if names := windows.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= names
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(words), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
