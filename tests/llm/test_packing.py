from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archivolt.llm import packing as P
from archivolt.llm import queries
from archivolt.llm.tokens import PieceTokenizer, tokenizer_path


def used(plan):
    out = Counter()
    for config, times in plan:
        for n, many in config.items():
            out[n] += many * times
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 200), max_size=25))
def test_plan_places_every_piece_once(histogram):
    plan = P.plan(histogram, 40, 20)
    assert used(plan) == Counter(histogram)
    assert all(sum(n * many for n, many in config.items()) <= 40 and times > 0 for config, times in plan)
    total = sum(n * c for n, c in histogram.items())
    assert sum(times for _, times in plan) <= 2 * -(-total // 40)


def test_plan_is_close_to_the_bound():
    rnd = random.Random(1)
    histogram = dict(Counter(rnd.randrange(1, 257) for _ in range(20_000)))
    bound = -(-sum(n * c for n, c in histogram.items()) // 256)
    assert sum(times for _, times in P.plan(histogram, 256)) <= bound * 1.005 + 1


def test_price_is_the_best_configuration():
    lengths, worth = np.array([3, 5, 7]), np.array([3.1, 5.0, 7.4])
    best, _ = P.price(lengths, worth, 11)
    for room in range(12):
        want = max(3.1 * a + 5.0 * b + 7.4 * c for a in range(4) for b in range(3) for c in range(2) if 3 * a + 5 * b + 7 * c <= room)
        assert best[room] == pytest.approx(want)


ODD = ["", " ", "Hello, WORLD!", "don't we're 'tis", "naïve ÉTÉ—dash", "éa ́ ≮", "ΑΣ ΣΑΣ", "a<|endoftext|>b", "x\x1cy\x85z\xa0w　v", "İstanbul ﬁ", "中文 テスト1234", "co-op(a)b'c\"d", "\t\n a\x0bb", "🙂🙂 ok🙂", "ª º µ × ÷ ß"]


def test_token_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    whole, ours = Tokenizer.from_file(tokenizer_path()), PieceTokenizer(tokenizer_path())
    rnd = random.Random(2)
    letters = "aAbéÉßIİσΣ1²'’-.,<|≯́ \n\x1c\x85\xa0—中🙂"
    for text in ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(3000)]:
        want = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert ours.encode(text) == want, repr(text)


def test_documents(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(3)
    texts = [None, "", "same text", "same text"] + [" ".join(rnd.choice(["the", "Über", "x9"]) for _ in range(rnd.randrange(90))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)] + [(2, "same text", "s", 1)], "doc_id long, text string, source string, length int")
    rows = P.pack_documents(docs, capacity=32).collect()
    want = Counter()
    for i, t in [*enumerate(texts), (2, "same text")]:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 32):
            part = np.array(ids[k : k + 32], "<u4")
            want[(i, k // 32, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 32
    total = sum(n for _, _, _, n, _ in want.elements())
    assert len(by) <= -(-total // 32) * 1.1 + 1


def _check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("scale", [300, 60])
def test_plan_is_never_worse_than_best_fit(scale):
    histogram = {n: int(2e6 * np.exp(-n / scale)) + 1 for n in range(1, 2049)}
    made, plain = (sum(times for _, times in p) for p in (P.plan(histogram), P.best_fit(histogram, P.CAPACITY)))
    assert made <= plain
    assert used(P.plan(histogram)) == Counter(histogram)


def test_salted_lengths_and_clashing_columns(spark):
    rows = [(i, 7 if i % 3 else i % 20 + 1, "a", 1, 2, "z") for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, length long, __n string, __salt int, offset int, __at string")
    out = P.pack(frame, capacity=32, ranked=50)
    got = out.collect()
    assert sorted(out.columns) == sorted([*frame.columns, "sequence_id"])
    assert {(r["__n"], r["__salt"], r["__at"]) for r in got} == {("a", 1, "z")} and sorted(r["doc_id"] for r in got) == list(range(2000))
    assert _check(got, 32) <= -(-sum(r[1] for r in rows) // 32) * 1.05 + 1


def test_query_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    whole = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = whole.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[(d["doc_id"], k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += 1
    got = queries.op2_best_fit_packing(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert _check(got, 2048) <= -(-sum(k[3] * c for k, c in want.items()) // 2048) + 1


def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
