"""Reply trees and the chat template."""

from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archivolt.llm import chat, queries

MESSAGE = "tree long, id long, parent long, role string, text string, score double"


def test_paths_of_a_tree_are_ranked_and_whole(spark):
    rows = [
        (1, 0, None, "user", "q", 0.0),
        (1, 1, 0, "assistant", "a", 1.0),
        (1, 2, 0, "assistant", "b", 3.0),
        (1, 3, 2, "user", "c", 3.0),
        (1, 4, 3, "assistant", "d", 3.0),
        (2, 9, 77, "user", "its parent is missing", None),
    ]
    found = chat.paths(spark.createDataFrame(rows, MESSAGE), best=1).orderBy("tree", "path", "depth").collect()
    assert [(r["tree"], r["path"], r["depth"], r["id"]) for r in found] == [(1, 4, 0, 0), (1, 4, 1, 2), (1, 4, 2, 3), (1, 4, 3, 4), (2, 9, 0, 9)]
    every = chat.paths(spark.createDataFrame(rows, MESSAGE))
    assert {(r["tree"], r["path"]) for r in every.collect()} == {(1, 1), (1, 4), (2, 9)}


def test_ranks_of_all_and_of_the_best_are_those_of_a_plain_sort(spark):
    rows = [(t, 0, None, "user", "q", 0.0) for t in (1, 2)] + [(t, i, 0, "assistant", str(i), float(i * 7 % 11)) for t in (1, 2) for i in range(1, 200 if t == 1 else 5)]
    frame = spark.createDataFrame(rows, MESSAGE)
    want = {t: sorted((i for u, i, *_ in rows if u == t and i), key=lambda i: (-(i * 7 % 11), i)) for t in (1, 2)}
    for best in (None, 3, 100):
        found = chat.paths(frame, best=best).select("tree", "path", "rank").distinct().collect()
        for t in (1, 2):
            got = [r["path"] for r in sorted(found, key=lambda r: r["rank"]) if r["tree"] == t]
            assert got == want[t][:best] and sorted(r["rank"] for r in found if r["tree"] == t) == list(range(1, len(got) + 1))


def test_ties_go_to_the_smaller_leaf_and_empty_input_is_empty(spark):
    rows = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "a", 1.0), (1, 2, 0, "assistant", "a", 1.0)]
    found = chat.paths(spark.createDataFrame(rows, MESSAGE), best=1)
    assert {r["path"] for r in found.collect()} == {1}
    assert chat.format_paths(chat.paths(spark.createDataFrame([], MESSAGE))).count() == 0


def test_a_long_chain_and_a_cycle(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(300)] + [(2, 0, 1, "user", "x", 0.0), (2, 1, 0, "user", "y", 0.0)]
    rows += [(2, 2, 1, "user", "below the cycle", 0.0), (3, 0, None, "user", "alone", 0.0)]
    found = chat.paths(spark.createDataFrame(rows, MESSAGE))
    assert [r["id"] for r in found.where("tree = 1").orderBy("depth").collect()] == list(range(300))
    assert {r["tree"] for r in found.collect()} == {1, 3}


def test_read_back_equals_what_went_in(spark):
    rows = [(1, 0, "system", None), (1, 2, "user", "x <|end|> \\ y"), (1, 5, "assistant", "[INST] </s> <<SYS>>"), (2, 0, None, ""), (2, 0, None, ""), (2, 1, "assistant", "ok"), (None, 3, "user", "no id"), (None, None, "assistant", "no turn")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    made = chat.format_paths(chat.paths(chat.from_turns(frame)))
    assert "</s>" not in made.where("tree = 1").first()["formatted"]
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}
    for conv in (1, 2, None):
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: x[0])
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="\\<|>[]/INSTs end", max_size=30), min_size=1, max_size=20))
def test_escaping_is_reversible(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    for r in frame.collect():
        assert r["t"] == r["u"] and "<|" not in r["e"] and "[INST]" not in r["e"] and "</s>" not in r["e"]


def test_a_long_conversation_is_read_back(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"é{i} \\ <|end|> " * 30) for i in range(600)]
    made = chat.format_paths(chat.paths(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), best=1))
    got = chat.digest(made).first()
    loss = "".join(x for _, _, r, x in rows if r == "assistant")
    assert got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in rows).encode()).hexdigest()


def test_query_against_brute_force(spark):
    sf, hostile = "/root/testdata/sf0.001", "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)]
    got = {r["conv_id"]: r for r in queries.op1_chat_formatting(spark, sf).collect()}
    assert got.keys() == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted((t, role or "", text or "") for c, t, role, text in rows if c == conv)
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
