"""Components over chains, stars, rings and drawn graphs, and how much is written for them."""

from __future__ import annotations

import random

import pytest

from archivolt.operators import graph


def plain(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        top[high] = low
    return {(x, find(x)) for x in top}


_DRAW = random.Random(5)
GRAPHS = {
    "down": [(i, i + 1) for i in range(300)],
    "zigzag": [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)],
    "star": [(500, i) for i in range(200)] + [(7, 7), (9_000, 9_000)],
    "drawn": [(_DRAW.randrange(400), _DRAW.randrange(400)) for _ in range(300)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    frame = spark.createDataFrame([*GRAPHS[name], (None, 1), (2, None)], "a long, b long")
    assert {tuple(r) for r in graph.connected(frame).collect()} == plain(GRAPHS[name])


def test_edges_of_settled_parts_are_not_dealt_again(spark, monkeypatch):
    """Small components settle at once; each round read all edges in both directions, and another round did to see that nothing changed."""
    edges = spark.createDataFrame([(8 * i, 8 * i + j) for i in range(200) for j in range(1, 8)], "a long, b long")
    sizes, write = [], graph.written

    def counted(df, name):
        made = write(df, name)
        sizes.append((name, made.count()))
        return made

    monkeypatch.setattr(graph, "written", counted)
    assert graph.connected(edges).count() == 1600
    assert sum(n for name, n in sizes if name == "links") == 1400
