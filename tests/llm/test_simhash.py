from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from archivolt.llm import common, queries
from archivolt.llm import simhash as S
from archivolt.llm.components import components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints):
    """Smallest place that links reach, by looking at all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def planted(seed, n=300):
    """Chains and balls of near fingerprints among far ones."""
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rnd.choice(out[:n])
        for _ in range(rnd.randrange(1, 5)):
            for _ in range(rnd.randrange(0, 5)):
                x ^= 1 << rnd.randrange(64)
            out.append(x)
    return out


@pytest.mark.parametrize("text", ["", None, " \t", "one", "Two  words", "a b c", "Ä É x y z\x0bq", "the cat sat on the mat " * 9])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_print(text)


def test_fingerprint_of_a_long_text_in_strides(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    monkeypatch.setattr(S, "_STRIDE", 7)
    assert S.fingerprint(text) == brute_print(text)


def test_gray_rank(spark):
    got = [r[0] for r in spark.range(16).select(S.gray_rank(S.F.col("id").bitwiseXOR(S.F.shiftright("id", 1)))).collect()]
    assert got == list(range(16))


@pytest.mark.parametrize("seed", [1, 2])
def test_index_finds_every_link(seed):
    prints = np.array(sorted(set(planted(seed))), np.uint64)
    group = np.zeros(len(prints), np.int64)
    index = S.GrayIndex(group, prints)
    a, b = index.links(0, len(prints), 3)
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


@pytest.mark.parametrize("blocks,group_rows", [(4, 4096), (4, 8), (5, 4096), (5, 8), (6, 4096)])
def test_links_join_the_same_components(spark, blocks, group_rows):
    prints = sorted(set(planted(3)), key=S._signed)
    roots = brute_roots(prints)
    frame = spark.createDataFrame([(S._signed(p),) for p in prints], "fp long")
    found = {r["node"]: r["root"] for r in components(S.near_links(frame, group_rows=group_rows, blocks=blocks)).collect()}
    assert [found.get(S._signed(p), S._signed(p)) for p in prints] == [S._signed(prints[r]) for r in roots]


def test_documents(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 40
    rows = [(5, base), (3, base + "nu"), (9, None), (2, ""), (7, "other words entirely here"), (7, "other words entirely here"), (8, base), (None, "lone row")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    prints = [brute_print(t) for _, t in rows]
    roots = brute_roots(prints)
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in S.digest(S.near_duplicates(frame)).collect())
    want = []
    for (i, _), p, r in zip(rows, prints, roots, strict=True):
        ids = [j for (j, _), q in zip(rows, roots, strict=True) if q == r and j is not None]
        want.append((i or -1, f"{p:016x}", min(ids, default=None)))
    assert got == sorted(want)
    kept = sorted(r["doc_id"] or -1 for r in S.keep_one(frame).collect())
    assert kept == sorted(i for i, _, c in want if i in (-1, c))
    assert S.keep_one(frame).columns == frame.columns


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_written_tables_are_replaced_and_removed(spark):
    from pathlib import Path

    common.clear(spark)
    components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()
    folder = Path(common.scratch_dir(spark))
    assert len(list(folder.glob("edges-*"))) == 1
    common.clear(spark)
    assert not list(folder.glob("edges-*"))


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_one_id_are_judged_by_their_text(spark):
    one, two = "alpha beta gamma delta " * 30, "quite other words stand in here " * 30
    rows = [(5, one, "a"), (5, two, "b"), (3, two, "c"), (3, two, "d"), (None, two, "e"), (8, None, "f"), (7, "", "g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __gone_id string")
    kept = S.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r["__gone_id"] for r in kept.collect()) == ["a", "c", "d", "e", "g"]
    assert S.keep_one(frame.limit(0)).count() == 0


def test_crowded_groups_get_longer_keys(spark):
    """Thousands of fingerprints that share a key, near links among them."""
    rnd = random.Random(4)
    prints = {0x1234 << 48 | rnd.getrandbits(48) for _ in range(1500)}
    for p in list(prints)[:300]:
        prints.add(p ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
    prints = sorted(prints, key=S._signed)
    roots = brute_roots(prints)
    frame = spark.createDataFrame([(S._signed(p),) for p in prints], "fp long")
    found = {r["node"]: r["root"] for r in components(S.near_links(frame, group_rows=100)).collect()}
    assert [found.get(S._signed(p), S._signed(p)) for p in prints] == [S._signed(prints[r]) for r in roots]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    prints = [brute_print(t) for _, t in rows]
    roots = brute_roots(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash_near_dedup(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, roots, strict=True)}
