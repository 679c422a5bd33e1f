"""Hash embeddings against sums over single tokens; tokens are hashed once, not once a dimension."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import hybrid as H


def test_hash_embedding(spark):
    rows = [(0, ["a", "b", "a"]), (1, []), (2, None), (3, [f"w{i}" for i in range(500)])]
    frame = spark.createDataFrame(rows, "k long, toks array<string>")
    out = frame.select("k", H.hash_embedding(F.col("toks"), 8).alias("e"))
    hashed = frame.select("k", F.explode("toks").alias("t")).select("k", F.pmod(F.xxhash64("t"), F.lit(8)).alias("d"), F.pmod(F.xxhash64("t", F.lit(1)), F.lit(2)).alias("s")).collect()
    want = {0: [0.0] * 8, 1: [0.0] * 8, 2: [None] * 8, 3: [0.0] * 8}
    for r in hashed:
        want[r["k"]][r["d"]] += 1 - 2 * r["s"]
    assert {r["k"]: r["e"] for r in out.collect()} == want
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
