"""Components of a long path, a star and random edges, against plain Python; nothing is broadcast."""

from __future__ import annotations

import random

from docquarry.operators import graph as G


def test_components(spark):
    rng = random.Random(4)
    edges = [(i + 1, i) for i in range(1000, 1060)] + [(i, 2000) for i in range(1900, 2200) if i != 2000] + [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    edges = [e for e in edges if e[0] != e[1]]
    least = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert {tuple(r) for r in G.components(frame).collect()} == set(least.items())
    assert "Broadcast" not in G._with_least(frame)._jdf.queryExecution().executedPlan().toString()
