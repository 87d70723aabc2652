"""Quality measures against plain Python, and the bounds of learned cutoffs."""

from __future__ import annotations

import random
import re
from collections import Counter
from math import comb

from pyspark.sql import functions as F

from archivolt.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None) -> dict[str, int]:
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(inside), "n_capitals": len(re.findall("[A-Z]", text))}


HARD = [None, "", " \n\t ", "a", "a b c d e", "a a a a a a", "a b c d e f a b c d e", "x\n\nx\n x\nx", "a b c d e " * 50, "é\u00a0ü \u2003 w\x1cv", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 1 2 3 4 5"]


def test_measures(spark):
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(HARD)], "doc_id long, text string, n_words string")
    for r in quality.measure(frame).collect():
        want = brute(HARD[r["doc_id"]])
        assert {k: r["quality"][k] for k in want} == want, HARD[r["doc_id"]]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op9_quality_rules(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = brute(text)
        assert {k: got[i][k] for k in want if k != "n_capitals"} == {k: n for k, n in want.items() if k != "n_capitals"}
        assert got[i]["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_upper_bound_is_exact():
    for k, n, error in ((0, 50, 0.05), (3, 80, 0.01), (10, 40, 0.1)):
        p = quality.upper_bound(k, n, error)
        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - error) < 1e-6
    assert quality.upper_bound(5, 5, 0.05) == 1.0 and quality.upper_bound(0, 0, 0.05) == 1.0
    assert 0.01 < quality.upper_bound(10**6, 10**8, 0.001) < 0.0101  # as fast for many as for few


def test_the_risk_is_kept_on_fresh_rows():
    """Over many draws of labels the true share of good rows rejected exceeds the risk no more often than allowed."""
    rnd, found = random.Random(3), quality.rules()[:1]
    levels = len(found[0].grid)
    good = [0.93, 0.03, 0.02, 0.01, 0.005, 0.003, 0.002]  # chances of the cutoffs exceeded by good rows
    bad = [0.1, 0.1, 0.1, 0.1, 0.1, 0.2, 0.3]
    worse = used = 0
    for _ in range(150):
        table = {}
        for stratum in "abc":
            for orders, n in ((True, 400), (False, 800)):
                cells = Counter(((level,), True) for level in rnd.choices(range(levels + 1), good, k=n))
                cells += Counter(((level,), False) for level in rnd.choices(range(levels + 1), bad, k=n // 4))
                table[stratum, orders] = [(over, fine, times) for (over, fine), times in cells.items()]
        chosen = quality.choose(table, found, 0.02, 0.05)
        used += bool(chosen)
        worse += any(sum(good[sorted(found[0].grid).index(cut) + 1 :]) > 0.02 for cut in chosen.values())
    assert used > 50 and worse <= 0.05 * 150 + 4


def test_the_verdict_on_labelled_documents(spark):
    """The rules catch bad documents that pass the base ones, and hold on rows they weren't learned from."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(3)) == 0
    judged = quality.judge(docs, labels.where(~fold)).join(labels.where(fold), "doc_id").where("not base_failed")
    of = {r["quality"]: (r["kept"], r["n"]) for r in judged.groupBy("quality").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()}
    assert of[0][0] < 0.2 * of[0][1] and of[1][0] >= 0.98 * of[1][1]


def _corpus(spark, n, lang="en"):
    good = " ".join(f"w{i}" for i in range(40))
    bad = " ".join(f"w{i}###$$" for i in range(40))
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, bad).otherwise(good).alias("text"), F.lit(lang).alias("lang"), F.lit(1).alias("kept"))
    return rows, rows.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality"))


def test_cutoffs_reject_the_bad_and_keep_the_good(spark):
    docs, labels = _corpus(spark, 6000)
    got = quality.judge(docs, labels).groupBy((F.col("doc_id") % 4 == 0).alias("bad")).agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()
    assert {(r["bad"], r["kept"], r["n"]) for r in got} == {(True, 0, 1500), (False, 4500, 4500)}


def test_few_labels_guarantee_nothing(spark):
    docs, labels = _corpus(spark, 200)
    assert quality.judge(docs, labels).where("kept").count() == 200
    assert quality.judge(docs, labels.limit(0)).where("kept").count() == 200


def test_nulls_repeats_contradictions_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (1, None, None), (None, "a b", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == 3 and all(r["base_failed"] for r in got)
    assert quality.judge(docs.limit(0), labels).count() == 0
