"""Vector search and fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn(vectors: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows of greatest cosine with one query vector, ties by key."""
    near = F.round(cosine(F.col(vector), F.array(*[F.lit(float(v)) for v in query])), 9)
    return vectors.withColumn("cosine", near).where("cosine is not null").orderBy(F.desc("cosine"), key).limit(k)


def rrf(lists: DataFrame, source: str, key: str, score: str) -> DataFrame:
    """Reciprocal rank fusion of (source, key, score): each source ranks a key once, by its best score."""
    once = lists.groupBy(source, key).agg(F.max(score).alias("_s"))
    rank = F.row_number().over(Window.partitionBy(source).orderBy(F.desc("_s"), key))
    return once.withColumn("_r", rank).groupBy(key).agg(F.sum(1 / (RRF_K + F.col("_r"))).alias("rrf"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))


def per_kind_floor(ranked: DataFrame, kind: str, order: Sequence[Column | str], total: int, floor: int, ceiling: int, deserving: Column | None = None) -> DataFrame:
    """`total` rows, in order, in which each kind has its best `floor`, as far as it has so many that
    are deserving, and the best of the rest fill up, no kind over `ceiling`. What is reserved stays
    even if that alone is more than `total`."""
    if ceiling < floor:
        raise ValueError("the ceiling must not be below the floor")
    fit = F.coalesce(deserving, F.lit(False)) if deserving is not None else F.lit(True)
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    judged = ranked.withColumn("_fit", fit).withColumn("_kept", F.col("_fit") & (nth(kind, "_fit") <= floor))
    kept = judged.where("_kept").drop("_fit", "_kept")
    own = kept.groupBy(kind).agg(F.count("*").alias("_own"))
    rest = judged.where("not _kept").withColumn("_nth", nth(kind)).join(own, kind, "left")
    rest = rest.where(F.col("_nth") <= ceiling - F.coalesce("_own", F.lit(0))).orderBy(*order).limit(total)
    place = F.row_number().over(Window.orderBy(*order))  # of `total` rows at most
    room = F.broadcast(own.agg((total - F.coalesce(F.sum("_own"), F.lit(0))).alias("_room")))
    filled = rest.withColumn("_place", place).crossJoin(room).where("_place <= _room").select(*ranked.columns)
    return kept.unionByName(filled).orderBy(*order)


def within_budget(ranked: DataFrame, order: Sequence[Column | str], cost: Column, budget: int, least: int) -> DataFrame:
    """The first rows whose costs together keep within a budget. least: what any row costs at least,
    so that no more than budget / least rows, the first, need summing."""
    first = ranked.orderBy(*order).limit(budget // least + 1)
    running = F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("spent", running).where(F.col("spent") <= budget)


def hash_embedding(tokens: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding service: signed token counts in `dim` buckets, for tests and offline use."""
    # Each token is hashed once: 2 * bucket, and 1 more for the negative sign.
    codes = F.transform(tokens, lambda t: (F.pmod(F.xxhash64(t), F.lit(dim)) * 2 + F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2))).cast("int"))

    def sums(column: pa.Array) -> pa.Array:
        """Null tokens have null sums."""
        code = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        total = np.bincount(row * dim + code // 2, 1.0 - 2 * (code % 2), len(column) * dim)
        values = pa.array(total, mask=np.repeat(column.is_null().to_numpy(zero_copy_only=False), dim))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * dim, pa.int32()), values)

    return F.arrow_udf(sums, "array<double>")(codes)
