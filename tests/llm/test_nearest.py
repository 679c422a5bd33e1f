"""Recall of the nearest vectors where they lie close together, tie, or differ much in length."""

from __future__ import annotations

import numpy as np
import pytest

from docquarry.llm import ann

RNG = np.random.default_rng(3)
N, DIM = 6000, 32
CENTRES = RNG.normal(size=(6, DIM))
TABLES = {
    "near copies": CENTRES[RNG.integers(0, 6, N)] + 0.01 * RNG.normal(size=(N, DIM)),
    "ties": (RNG.random((N, DIM)) < 0.1).astype(float),
    "lengths": RNG.normal(size=(N, DIM)) * RNG.lognormal(0, 1.5, size=(N, 1)),
}


@pytest.mark.parametrize("name", TABLES)
def test_recall(spark, name):
    x = TABLES[name].astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    found = {}
    for r in ann.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = x.astype(np.float64)
    fair = np.flatnonzero(np.any(x != 0, axis=1))
    hits = 0
    for q in found:
        own = fair[fair != q]
        hits += len(found[q] & set(own[np.lexsort((own, -(x[own] @ x[q])))[:20]].tolist()))
    assert set(found) == {i for i in fair.tolist() if i % 20 == 0}
    assert hits >= 0.95 * 20 * len(found)
