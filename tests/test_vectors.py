"""Nearest vectors of more queries than meet rows in one product."""

from __future__ import annotations

import numpy as np

from archivolt.operators import vectors


def test_queries_of_several_products(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(vectors.SIDE + 300, 4))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = np.round(unit @ unit.T, 9)
    np.fill_diagonal(like, -np.inf)
    want = {(q, int(v), r + 1) for q in range(len(x)) for r, v in enumerate(np.lexsort((np.arange(len(x)), -like[q]))[:3])}
    assert {tuple(r) for r in vectors.nearest(frame, frame, k=3).collect()} == want
    assert vectors.SIDE * vectors.SLICE * 8 <= 16 << 20  # bytes of one product; it was 134 MB, held three times
