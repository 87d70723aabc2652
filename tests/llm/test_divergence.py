"""Differences of sources against their definition."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb

from archivolt.llm import divergence, queries

SCHEMA = "lang string, source string, text string"


def plain(rows, least, ranks):
    """Every kept term of every pair, in Python's integers."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(a or "", b or "", term.findall((c or "").translate(low))) for a, b, c in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        within = Counter(t for _, _, terms in own for t in set(terms))
        kept = [t for t, n in within.items() if n >= least]
        counts = {s: Counter(t for _, b, terms in own if b == s for t in terms if within[t] >= least) for s in {d[1] for d in own}}
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(kept)) if kept else 0
        p = {s: {t: share(c[t], sum(c.values())) for t in kept} for s, c in counts.items()}
        whole = sum(counts.values(), Counter())
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in counts:
            pairs = [(h, sum(abs(p[s][t] - p[h][t]) for t in kept)) for h in counts if h != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(order[:most])}
    return out


def got(frame):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def drawn(seed, n=400):
    """Sources of very different sizes, so that rare terms of large ones lie below the zero share of small ones."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(3)] + ["Éa", "éA", "日本", "Zeta", "zETA", "x_y", "q1r", "don't"] + [chr(97 + i) * 3 for i in range(26)]
    rows = []
    for _ in range(n):
        source = draw.choice(["big"] * 12 + ["mid"] * 3 + ["tiny", "", None, "none"])
        length = {"big": 60, "mid": 20}.get(source, 3)
        text = "" if source == "none" else " ".join(draw.choices(words, k=length, weights=[draw.random() ** 4 + 1e-6 for _ in words]))
        rows.append((draw.choice(["en", "en", "de", None, ""]), source, draw.choice([text, text, text, None])))
    return rows


def test_against_definition(spark):
    for seed, least, ranks in ((1, 3, 5), (2, 30, 50), (3, 1, 2)):
        rows = drawn(seed)
        assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA), least_docs=least, ranks=ranks)) == plain(rows, least, ranks)


def test_shares_below_the_others_zero_share_are_counted(spark):
    rows = [("en", "large", "rare " + "common " * 50_000)] + [("en", "small", "common")] + [("en", "third", " ".join(["rare", "odd"]))] * 2
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA), least_docs=1)) == plain(rows, 1, 50)


def test_partial_counts_are_passed_on_when_many_are_held(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "BATCH", 2)
    rows = drawn(9, 200)
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(7), least_docs=2)) == plain(rows, 2, 50)


def test_nothing_kept_long_texts_other_columns_and_empty_tables(spark):
    rows = [("en", "a", "x " * 200_000), ("en", "b", ""), ("en", "c", None)]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", n int, term string")
    assert got(divergence.audit(frame)) == plain(rows, 30, 50) and {r[4] for r in plain(rows, 30, 50)} == {0}
    assert divergence.audit(frame.limit(0)).count() == 0


def test_exact_beyond_doubles(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(10**13 + 3, 7 * 10**15 + 1, 10**9)], "n long, total long, kept long")
    got = row.select(divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (10**13 + 8) // (7 * 10**15 + 1 + 5 * 10**9)


def test_query_equals_its_sql(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(divergence.oracle_sql())
    names = [d[0] for d in want.description]
    rows = [dict(zip(names, r)) for r in want.fetchall()]
    assert got(queries.op13_source_divergence(spark, sf)) == {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows}
