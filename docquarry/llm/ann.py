"""Maximum inner product search by anisotropic four-bit product codes in coarse cells and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, table

CENTRES = 16
#: Vectors that fit the codebooks: those of the least xxhash64(vec_id). Every vector is encoded.
SAMPLE = 4096
#: Vectors that a coarse cell is meant for; most centres of either level, so that the table of cells
#: stays bounded (a million cells; beyond that many times CELL vectors cells grow with the data).
CELL, MOST_CENTRES = 512, SAMPLE // 4
#: The share of the true nearest of TRIALS queries that the probed cells must hold; the number of
#: probes is measured for it. Candidates that the cells of a query must hold together at least.
COVERED, TRIALS, LEAST_CANDIDATES = 0.99, 64, 2048
#: Codes of a region of cells, which one task scans, and queries that it takes; candidates that a
#: region passes on for a query beyond `top`, as exact scores of a task may be summed in another order.
REGION, QUERY_BLOCK, SPARE = 16384, 1024, 12
#: Bound of what single precision adds to the error of an approximate inner product of unit vectors.
SLACK = 1e-5
#: Share of the norm from which an inner product counts as large; it sets how much more an error
#: along the vector costs than one across it.
THRESHOLD = 0.2


def parallel_weight(dim: int, threshold: float = THRESHOLD) -> float:
    """How many times an error along the vector counts, against one across it; at least 1."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _parts(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(n, subspaces, width), padded with zeros."""
    subs, _, width = books.shape
    return np.pad(x, ((0, 0), (0, subs * width - x.shape[1]))).reshape(len(x), subs, width)


def assign(x: np.ndarray, books: np.ndarray, weight: float, rounds: int = 2) -> np.ndarray:
    """Codes (n, subspaces) that lower |r|^2 + (weight - 1) (r . x/|x|)^2 of the residual r, one
    subspace after another with the others held."""
    parts = _parts(x, books)
    unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
    apart = parts[:, :, None, :] - books[None]
    square = (apart**2).sum(3)
    along = (apart * unit[:, :, None, :]).sum(3)
    codes = square.argmin(2)
    rows = np.arange(len(x))
    sums = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]
    total = sums.sum(1)
    for _ in range(rounds):
        for s in range(books.shape[0]):
            rest = total - sums[:, s]
            codes[:, s] = (square[:, s] + (weight - 1) * (rest[:, None] + along[:, s]) ** 2).argmin(1)
            sums[:, s] = along[rows, s, codes[:, s]]
            total = rest + sums[:, s]
    return codes.astype(np.uint8)


def train(x: np.ndarray, width: int = 1, rounds: int = 6) -> np.ndarray:
    """Codebooks (subspaces, 16, width): least squares starts, then centres that solve the weighted
    normal equations of the codes found so far."""
    dim = x.shape[1]
    subs = -(-dim // width)
    weight = parallel_weight(dim)
    rng = np.random.default_rng(0)
    start = np.pad(x, ((0, 0), (0, subs * width - dim))).reshape(len(x), subs, width)
    books = np.stack([start[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), s] for s in range(subs)]).astype(np.float64)
    unit = start / np.linalg.norm(x, axis=1)[:, None, None]
    eye = np.eye(width)
    for turn in range(2 * rounds):
        w = 1.0 if turn < rounds else weight
        codes = assign(x, books, w, 1)
        chosen = books[np.arange(subs)[None], codes]
        along = ((start - chosen) * unit).sum(2)
        rest = along.sum(1)[:, None] - along
        for s in range(subs):
            for k in range(CENTRES):
                own = codes[:, s] == k
                if own.any():
                    u, v = unit[own, s], start[own, s]
                    left = own.sum() * eye + (w - 1) * u.T @ u
                    right = v.sum(0) + (w - 1) * ((rest[own, s] + (u * v).sum(1))[:, None] * u).sum(0)
                    books[s, k] = np.linalg.solve(left, right)
    return books


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def centres(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k means of x, from rows of x spread over it."""
    found = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = ((found**2).sum(1)[None] - 2 * x @ found.T).argmin(1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=k)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


@dataclass(frozen=True)
class Coarse:
    """Cells of two levels: the nearest first centre, then the nearest second centre to the rest.
    A cell's centre is the sum, so that k x k cells take 2 k centres and 2 k comparisons."""

    first: np.ndarray
    second: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, k: int) -> Coarse:
        first = centres(x, k)
        rest = x - first[((first**2).sum(1)[None] - 2 * x @ first.T).argmin(1)]
        return cls(first, centres(rest, k))

    def cells(self, x: np.ndarray) -> np.ndarray:
        one = ((self.first**2).sum(1)[None] - 2 * x @ self.first.T).argmin(1)
        two = ((self.second**2).sum(1)[None] - 2 * (x - self.first[one]) @ self.second.T).argmin(1)
        return one * len(self.second) + two

    def order(self, query: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Cells that aren't empty by the inner product of their centres, best first."""
        score = ((self.first @ query)[:, None] + (self.second @ query)[None]).ravel()
        score[counts == 0] = -np.inf
        return np.argsort(-score, kind="stable")[: int((counts > 0).sum())]

    def probes(self, query: np.ndarray, counts: np.ndarray, least: int, candidates: int) -> np.ndarray:
        """The first `least` cells, and more until they hold `candidates`."""
        order = self.order(query, counts)
        return order[: max(least, int(np.searchsorted(np.cumsum(counts[order]), candidates)) + 1)]


def _encoder(books: np.ndarray, coarse: Coarse, dim: int, weight: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes of directions, the length of each vector, and how far the code is from the direction."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vectors = _vectors(part.column("embedding"), dim)
                norm = np.linalg.norm(vectors, axis=1)
                unit = vectors / norm[:, None]
                codes = assign(unit, books, weight)
                off = np.linalg.norm((_parts(unit, books) - books[np.arange(len(books))[None], codes]).reshape(len(unit), -1), axis=1)
                if codes.shape[1] % 2:
                    codes = np.pad(codes, ((0, 0), (0, 1)))
                packed = codes[:, ::2] | (codes[:, 1::2] << 4)
                yield pa.record_batch(
                    {
                        "c": part.column("c"), "least": part.column("least"), "cell": pa.array(coarse.cells(vectors).astype(np.int32)),
                        "code": pa.array([row.tobytes() for row in packed], pa.binary()), "norm": pa.array(norm), "off": pa.array(off), "embedding": part.column("embedding"),
                    }
                )

    return run


def _prober(coarse: Coarse, counts: np.ndarray, regions: np.ndarray, dim: int, probes: int, candidates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and region, with the query's cells there."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own, region, cells = [], [], []
                for i, x in enumerate(_vectors(part.column("embedding"), dim)):
                    found = coarse.probes(x, counts, probes, candidates)
                    for r in np.unique(regions[found]).tolist():
                        own.append(i)
                        region.append(r)
                        cells.append(found[regions[found] == r].astype(np.int32))
                row = pa.array(own, pa.int64())
                yield pa.record_batch(
                    {"q": part.column("q").take(row), "region": pa.array(region, pa.int32()), "cells": pa.array(cells, pa.list_(pa.int32())), "embedding": part.column("embedding").take(row)}
                )

    return run


def _exact(queries: np.ndarray, top: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The `top` vectors of a partition for each of a few queries, by exact inner products."""
        ids, scores = np.empty((len(queries), 0), np.int64), np.empty((len(queries), 0))
        for batch in batches:
            got = queries @ _vectors(batch.column("embedding"), dim).T
            ids = np.hstack([ids, np.broadcast_to(batch.column("c").to_numpy(), got.shape)])
            scores = np.hstack([scores, got])
            best = np.argsort(-scores, axis=1, kind="stable")[:, :top]
            ids, scores = np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)
        of = np.repeat(np.arange(len(queries)), ids.shape[1])
        yield pa.record_batch({"t": pa.array(of), "c": pa.array(ids.ravel()), "score": pa.array(scores.ravel())})

    return run


def scan(packed: np.ndarray, books: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Approximate inner products of one query with all packed codes (bytes, n): each byte, two
    four-bit codes, looks up the sum of its two table entries."""
    tables = np.einsum("skw,sw->sk", books, _parts(query[None], books)[0])
    if len(tables) % 2:
        tables = np.vstack([tables, np.zeros(CENTRES)])
    pairs = (tables[1::2, :, None] + tables[::2, None, :]).reshape(-1, CENTRES * CENTRES).astype(np.float32)
    out = np.zeros(packed.shape[1], np.float32)
    for lut, codes in zip(pairs, packed, strict=True):
        out += lut[codes]
    return out


def chosen(score: np.ndarray, bound: np.ndarray, exact, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, and exact scores, of all that may be among the `top` largest: first the best of `score`
    are taken exactly, then what by its bound can reach the worst of them."""
    if len(score) > top:
        first = np.argpartition(-score, top - 1)[:top]
        at = np.flatnonzero(bound >= exact(first).min())
    else:
        at = np.arange(len(score))
    return at, exact(at)


def _scanner(books: np.ndarray, dim: int, top: int):
    schema = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("approx", pa.float64()), ("least", pa.int64())])

    def run(codes: pa.Table, queries: pa.Table) -> pa.Table:
        """For each query the best of its cells by exact inner product, ties by the least vec_id; codes
        and the error of each settle which vectors are taken exactly."""
        if not codes.num_rows or not queries.num_rows:
            return schema.empty_table()
        codes = codes.sort_by("cell")
        packed = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(codes.num_rows, -1).T.copy()
        every, held, least, norm, off = (codes.column(c).to_numpy() for c in ("c", "cell", "least", "norm", "off"))
        vectors = _vectors(codes.column("embedding"), dim)
        out = []
        for query, q, cells in zip(_vectors(queries.column("embedding"), dim), queries.column("q").to_numpy(), queries.column("cells"), strict=True):
            cells = cells.values.to_numpy()
            own = [np.arange(a, b) for a, b in zip(np.searchsorted(held, cells), np.searchsorted(held, cells, side="right"), strict=True)]
            at = np.concatenate(own)
            length = np.linalg.norm(query)
            got = scan(packed[:, at], books, query / length)
            scale = length * norm[at]
            near, score = chosen(got * scale, (got + off[at] + SLACK) * scale, lambda i: vectors[at[i]] @ query, top)  # noqa: B023
            ids = at[near]
            best = np.lexsort((least[ids], -score))[: top + SPARE]
            out.append((np.full(len(best), q), every[ids[best]], score[best], least[ids[best]]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part: neither null, the vector not zero and without
    null or non-finite components."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0)
    )


def _measured(classes: DataFrame, coded: DataFrame, queries: DataFrame, coarse: Coarse, counts: np.ndarray, dim: int, top: int) -> int:
    """The least number of probes that hold COVERED of the true nearest of TRIALS queries, those of
    the least hash, found by an exact scan of all vectors for these few."""
    tried = np.array([r[0] for r in queries.orderBy(F.xxhash64("q")).limit(TRIALS).select("embedding").collect()], dtype=np.float64)
    if not len(tried):
        return 1
    near = classes.select("c", "embedding").mapInArrow(_exact(tried, top + 1, dim), "t long, c long, score double")
    best = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), "c"))
    near = near.withColumn("_r", best).where(F.col("_r") <= top + 1)  # itself may be among them
    places = []
    orders = [{int(c): i for i, c in enumerate(coarse.order(x, counts))} for x in tried]
    for r in near.join(coded.select("c", "cell"), "c").select("t", "cell").collect():  # TRIALS times top + 1 rows
        places.append(orders[r["t"]][r["cell"]] + 1)
    return int(np.quantile(places, COVERED, method="higher")) if places else 1


def _of_length(spark: SparkSession, fine: DataFrame, dim: int, every: int, top: int, probes: int | None) -> DataFrame:
    """`nearest` for rows (q: the row's number, vec_id, embedding) of one length."""
    # Equal vectors are one class; of its rows no more than these can be among the nearest of any.
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id", "q"))
    some = fine.withColumn("_n", first).where(F.col("_n") <= top + 1)
    classes = materialize(
        spark, some.groupBy("embedding").agg(F.array_sort(F.collect_list(F.struct("vec_id", "q"))).alias("members")).withColumn("c", F.monotonically_increasing_id()), "vector-classes"
    )
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("embedding"), F.element_at("members", 1)["vec_id"]).limit(SAMPLE).select("embedding").collect()
    x = np.array([r[0] for r in sample], dtype=np.float64)
    books, weight = train(x / np.linalg.norm(x, axis=1)[:, None]), parallel_weight(dim)
    k = max(1, min(MOST_CENTRES, len(x), math.ceil(math.sqrt(n / CELL))))
    coarse = Coarse.fit(x, k)

    kind = fine.schema["embedding"].dataType.simpleString()
    encoded = classes.select("c", F.element_at("members", 1)["vec_id"].alias("least"), "embedding").mapInArrow(
        _encoder(books, coarse, dim, weight), f"c long, least long, cell int, code binary, norm double, off double, embedding {kind}"
    )
    coded = materialize(spark, encoded, "vector-codes")
    counts = np.zeros(k * k, np.int64)
    for r in coded.groupBy("cell").count().collect():  # at most MOST_CENTRES squared
        counts[r["cell"]] = r["count"]
    # Small cells side by side share a region, a large one is dealt out over several.
    several = np.maximum(1, -(-counts // REGION))
    regions = (np.cumsum(np.where(several > 1, 0, counts)) // REGION).astype(np.int64)
    large = np.flatnonzero(several > 1)
    regions[large] = regions.max(initial=0) + 1 + np.cumsum(several[large]) - several[large]

    queries = fine.where(F.col("vec_id") % every == 0)
    if probes is None:
        probes = _measured(classes, coded, queries, coarse, counts, dim, top)
    ask = _prober(coarse, counts, regions, dim, probes, LEAST_CANDIDATES)
    asked = materialize(spark, queries.select("q", "embedding").mapInArrow(ask, f"q long, region int, cells array<int>, embedding {kind}"), "vector-probes")
    cells = spark.createDataFrame([(i, int(regions[i]), int(several[i])) for i in np.flatnonzero(counts).tolist()], "cell int, region int, _several int")
    asks = asked.groupBy("region").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("_blocks"))
    sizes = materialize(spark, cells.join(asks, "region"), "vector-cells")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = coded.join(sizes, "cell").select((F.col("region") + own("c", "_several")).alias("part"), each("_blocks").alias("qb"), "c", "least", "cell", "code", "norm", "off", "embedding")
    of_region = sizes.groupBy("region").agg(F.first("_blocks").alias("_blocks"), F.max("_several").alias("_several"))
    right = asked.join(of_region, "region").select("q", "cells", "embedding", own("q", "_blocks").alias("qb"), F.explode(F.sequence(F.col("region"), F.col("region") + F.col("_several") - 1)).alias("part"))
    key = ["part", "qb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_scanner(books, dim, top + 1), "q long, c long, approx double, least long")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("approx"), "least"))
    short = found.withColumn("_r", best).where(F.col("_r") <= top + 1 + SPARE).select("q", "c")
    exact = F.expr("aggregate(zip_with(v, embedding, (x, y) -> cast(x as double) * cast(y as double)), 0d, (s, p) -> s + p)")
    scored = (
        short.join(classes.select("c", F.col("embedding").alias("v"), "members"), "c")
        .join(queries.select("q", F.col("vec_id").alias("query_id"), "embedding"), "q")
        .select("q", "query_id", exact.alias("score"), F.explode("members").alias("_m"))
        .where(F.col("_m.q") != F.col("q"))
    )
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "_m.vec_id", "_m.q"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", F.col("_m.vec_id").alias("vec_id"), "score")


def nearest(spark: SparkSession, vectors: DataFrame, every: int = 20, top: int = 20, probes: int | None = None) -> DataFrame:
    """The `top` other rows of largest inner product for each row whose vec_id is divisible by `every`.

    Codebooks and coarse centres are fitted on SAMPLE vectors; all vectors are encoded, 4 bits for
    a dimension, and dealt to coarse cells whose number grows with the vectors. A query's best
    cells by inner product are scanned by table; each code carries its error, and all vectors that
    may be among the `top` by it are reranked by exact inner products in double precision: within
    its cells a query misses none. `probes`: cells a query; if None, it is measured so that
    they hold COVERED of the true nearest of TRIALS queries: few cells where vectors lie in groups,
    many where they have no structure that cells could follow. With as many as there are cells the
    scan is over all vectors.

    Only a query's own row is shut out, not others of its vec_id or vector; rows that repeat are
    searched for and found each. Ties go to the smaller vec_id. Rows that aren't `usable` take no
    part; vectors of different lengths have no inner product, each length is searched by itself. An
    empty table gives an empty result, other columns are ignored.

    Returns query_id, rank, vec_id, score.
    """
    fine = materialize(spark, usable(vectors).withColumn("q", F.monotonically_increasing_id()), "vectors")
    lengths = sorted(r["d"] for r in fine.select(F.size("embedding").alias("d")).distinct().collect())
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in lengths:
        out = out.unionByName(_of_length(spark, fine.where(F.size("embedding") == d), d, every, top, probes))
    return out


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product for every vector whose id is divisible by 20."""
    return nearest(spark, table(spark, sf_dir, "embeddings"))
