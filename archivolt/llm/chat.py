"""Chat formatting over reply trees, by DataFrame functions alone.

Messages name their parent.  Iterative self-joins double the known distance to
the root, so a tree of depth d takes about log2(d) rounds; each root-to-leaf
path is then ranked by the mean score of its messages within its tree, and the
best paths are written by a template.

The template: ``<|turn|>role<|text|>text<|end|>`` for every turn.  Inside roles
and texts a backslash parts every string that could be read as control (the
template's own and those of widespread chat formats), and backslashes are
doubled, so taking out one backslash before any character gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from archivolt.llm.common import blocks, cut, let, materialize

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: The role whose texts a model learns from.
LEARNED = "assistant"
#: First characters of control strings, if the rest follows.
_CONTROL = r"(<(?=\||/?s>|</?SYS>>|/SYS>>|start_of_turn>|end_of_turn>)|\[(?=/?INST\]|/?SYSTEM_PROMPT\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame, *, best: int | None = None) -> DataFrame:
    """(tree, path, rank, depth, id, role, text) of the chosen root-to-leaf paths.

    ``messages``: tree, id, parent (null: a root), role, text, score.  ``id`` is
    unique in its tree.  A path is named by its leaf.  Paths of a tree rank by
    mean score (null counts as 0), ties by leaf, from 1; ``best`` keeps that many of
    each tree, None all.  Messages whose parent is missing are roots; those on a cycle,
    or below one, have no root and are on no path.  Null trees are one tree; rows
    with a null id can't be named and are on no path.
    """
    # wrapped, so that the rows of a null tree meet each other in joins
    whole = materialize(messages.select(F.struct("tree").alias("tree"), "id", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    links = whole.select("tree", "id", "parent")
    known = links.select("tree", F.col("id").alias("parent"))
    rooted = links.join(known.withColumn("__known", F.lit(True)), ["tree", "parent"], "left").select("tree", "id", F.when(F.col("__known"), F.col("parent")).alias("parent"))
    parents = rooted.where("parent is not null").select("tree", F.col("parent").alias("id")).distinct()
    leaves = rooted.select("tree", "id").join(parents, ["tree", "id"], "left_anti")

    # jump: how many steps up "up" is; null up: the root was passed
    jumps = materialize(rooted.select("tree", "id", F.col("parent").alias("up")), "jumps")
    chains = [jumps]  # chains[k]: 2**k steps up
    sizes = whole.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    while True:
        last = chains[-1].where("up is not null")
        onward = chains[-1].select("tree", F.col("id").alias("up"), F.col("up").alias("further"))
        longer = materialize(last.join(onward, ["tree", "up"]).select("tree", "id", F.col("further").alias("up")).where("up is not null"), "jumps")
        if longer.isEmpty():
            break
        if 2 ** len(chains) > sizes:  # more steps than the largest tree has messages: these walk a cycle
            leaves = leaves.join(longer.select("tree", "id"), ["tree", "id"], "left_anti")
            break
        chains.append(longer)

    # each leaf with all its ancestors: the binary digits of a distance say which jumps to take
    on = materialize(leaves.select("tree", F.col("id").alias("path"), "id", F.lit(0).cast("long").alias("up_by")), "paths")
    for k in range(len(chains) - 1, -1, -1):
        jump = chains[k].where("up is not null").select("tree", "id", "up")
        longer = on.join(jump, ["tree", "id"]).select("tree", "path", F.col("up").alias("id"), (F.col("up_by") + 2**k).alias("up_by"))
        on = on.unionByName(materialize(longer, "paths"))  # written: each step reads all before it, so a lazy plan would double
    scored = on.join(whole.select("tree", "id", "score"), ["tree", "id"])
    chosen = materialize(ranked(scored.groupBy("tree", "path").agg(F.max("up_by").alias("length"), F.avg("score").alias("mean")), best), "ranks")
    full = on.join(chosen, ["tree", "path"]).join(whole.select("tree", "id", "role", "text"), ["tree", "id"])
    return full.select("tree.tree", "path", "rank", (F.col("length") - F.col("up_by")).alias("depth"), "id", "role", "text")


def ranked(scores: DataFrame, best: int | None, parts: int = 64) -> DataFrame:
    """(tree, path, length, rank): paths by mean score, then leaf; ``best`` of each tree, or all.

    With ``best``, each of ``parts`` parts of a tree keeps its own best first, so
    no tree is sorted in one task; without it a tree's ranks are counted part by
    part, by ranges of scores that a sort of all paths gives.
    """
    by_score = [F.desc("mean"), F.col("path")]
    if best is not None:
        part = F.pmod(F.xxhash64("path"), F.lit(parts))
        own = scores.withColumn("part", part).withColumn("rank", F.row_number().over(W.Window.partitionBy("tree", "part").orderBy(*by_score))).where(F.col("rank") <= best)
        return own.withColumn("rank", F.row_number().over(W.Window.partitionBy("tree").orderBy(*by_score))).where(F.col("rank") <= best).drop("part", "mean")
    # sorted over all tasks; a task's rows are one range of (tree, score), so a rank is that in the range and what the ranges before it hold of the tree
    spread = materialize(scores.orderBy("tree", *by_score).withColumn("part", F.spark_partition_id()), "scores")
    before = W.Window.partitionBy("tree").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    counts = spread.groupBy("tree", "part").agg(F.count("*").alias("n")).select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = spread.withColumn("at", F.row_number().over(W.Window.partitionBy("tree", "part").orderBy(*by_score)))
    return inner.join(counts, ["tree", "part"]).select("tree", "path", "length", (F.col("at") + F.col("before")).alias("rank"))


def format_paths(turns: DataFrame, *, learned: str = LEARNED) -> DataFrame:
    """(tree, path, formatted, loss): each path as one text with its loss mask.

    ``turns``: tree, path, depth, role, text.  ``loss`` holds (start, length) in
    code points of the formatted text: the escaped texts of the learned role, in
    order.  Null roles and texts are empty.  A path of no turns doesn't occur.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(TURN), role, F.lit(TEXT))
    cut = turns.select("tree", "path", "depth", (F.coalesce("role", F.lit("")) == learned).alias("learn"), head.alias("head"), text.alias("body"))
    earlier = W.Window.partitionBy("tree", "path").orderBy("depth").rowsBetween(W.Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    placed = cut.withColumn("at", F.coalesce(F.sum(size).over(earlier), F.lit(0)) + F.length("head"))
    span = F.when(F.col("learn"), F.struct(F.col("at").cast("int").alias("start"), F.length("body").alias("length")))
    rows = placed.groupBy("tree", "path").agg(F.sort_array(F.collect_list(F.struct("depth", "head", "body"))).alias("t"), F.sort_array(F.collect_list(span)).alias("loss"))
    return rows.select("tree", "path", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"), "loss")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: p != "")
    after = lambda p: F.split(F.substring(p, len(TURN) + 1, 2**31 - 1), r"<\|text\|>", 2)
    return F.transform(pieces, lambda p: F.struct(unescape(after(p)[0]).alias("role"), unescape(after(p)[1]).alias("text")))


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return let(blocks(formatted), lambda held: F.array_join(F.transform(loss, lambda m: unescape(cut(held, m["start"], m["start"] + m["length"]))), ""))


def from_turns(rows: DataFrame) -> DataFrame:
    """Messages of ``paths`` from linear conversations: each turn answers the one before it.

    Rows with the same turn follow one another by role, then text.
    """
    order = W.Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select(F.col("conv_id").alias("tree"), "role", "text", (F.row_number().over(order) - 1).cast("long").alias("id"))
    return numbered.select("tree", "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted text and its mask."""
    turns = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = masked(F.col("formatted"), F.col("loss"))
    read = formatted.select(F.col("tree").alias("conv_id"), "formatted", turns.alias("turns"), loss.alias("lossy"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("lossy").cast("long").alias("loss_chars"),
        F.sha2("lossy", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
