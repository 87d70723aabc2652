"""License scans; the query also has SQL."""

from __future__ import annotations

import random

import duckdb

from archivolt.llm import licenses, queries


def test_lines_paragraphs_and_whole_texts():
    held = licenses.index()
    mit = dict(licenses.TEMPLATES)["MIT"]
    cut = mit.split(", ")
    assert licenses.scan("x y z\nReleased under the MIT license\nmore", held)[0][:3] == ("MIT", 1.0, 1)
    got = licenses.scan("intro of some words\n\n" + ",\n".join(cut) + "\n\nend of it", held)
    assert [(g[0], g[2], g[3]) for g in got] == [("MIT", 2, 1 + len(cut))]
    assert {g[0] for g in licenses.scan("This work is licensed under the GNU General Public License, version 3.", held)} >= {"GPL-3.0"}
    assert licenses.scan("the quick brown fox", held) == licenses.scan("", held) == licenses.scan(None, held) == licenses.scan("MIT", held) == []


def test_size_bounds_lose_nothing():
    held = licenses.index()
    for size in range(1, 120):
        fitting = {id(b) for _, b in held.fitting(size)}
        for _, b in held.templates:
            if 2 * min(size, len(b)) / (size + len(b)) >= held.threshold:
                assert id(b) in fitting


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(licenses.oracle_sql()).fetchall())
    got = sorted(tuple(r) for r in queries.op6_license_scans(spark, sf).collect())
    assert got == want and any(r[1] for r in got)


def test_frames_with_nulls_repeats_and_extra_columns(spark):
    frame = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "Released under the MIT License.", None)], "doc_id long, text string, license int")
    got = licenses.find_licenses(frame).orderBy("doc_id").collect()
    assert [len(r["licenses"]) for r in got] == [0, 0, 1] and got[0]["license"] == 5
    assert licenses.find_licenses(frame.limit(0)).count() == 0


def test_notices_among_other_words_and_whole_texts():
    held = licenses.index()
    names = lambda text: {s[0] for s in licenses.scan(text, held)}
    assert "CC-BY-NC-4.0" in names("Licensed under CC BY-NC 4.0.")
    prose = "the river ran past the old mill and nobody in the village could say for how long "
    assert "CC-BY-NC-4.0" in names(prose * 3 + "Licensed under CC BY-NC 4.0. " + prose)
    gpl = dict(licenses.TEMPLATES)["GPL-3.0"].split()
    wrapped = "\n".join([prose, *(" ".join(gpl[i : i + 9]) for i in range(0, len(gpl), 9)), prose, prose])
    found = {s[0]: s for s in licenses.scan(wrapped, held)}
    assert found["GPL-3.0"][1:3] == (1.0, 1)
    for name, text in licenses.TEMPLATES:
        if len(text) > 700:
            assert name in names(f"{prose}\n{text}\n\n{prose * 200}")
    assert names(prose * 50) == set()


def test_runs_of_words_against_brute_force():
    draw = random.Random(5)
    templates = tuple((f"t{k}", " ".join(draw.choices("abcde", k=n))) for k, n in enumerate((2, 4, 6, 9, 14)))
    held = licenses.index(templates)
    for _ in range(400):
        words = [w.encode() for w in draw.choices("abcde", k=draw.randint(0, 40))]
        want = {}
        for name, text in templates:
            t, n = licenses.bigrams([w.encode() for w in text.split()]), len(text.split())
            for a in range(len(words) - n + 1):
                b = licenses.bigrams(words[a : a + n])
                score = 2 * len(b & t) / (len(b) + len(t))
                if score >= held.threshold and (name not in want or score > want[name][0]):
                    want[name] = (score, a, a + n - 1)
        assert {x[0]: x[1:] for x in licenses._windows(words, held)} == want
