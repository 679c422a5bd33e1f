"""Codebooks of vector parts, refined over Hilbert-sorted blocks with boxes and sums."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, release, slices, small_batches, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Part rows of a block.
BLOCK = 256


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (n, dims), of whole numbers below 2^bits, on the Hilbert curve: the axes
    are unrotated from the highest bit down, the rest is Gray-coded, and the bits are interleaved.
    dims * bits is 62 at most."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            high = (x[d] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> level) & 1)
    return out


def _splitter(dim: int, low: np.ndarray, high: np.ndarray, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors to parts: (part, place on the part's curve, row, whole components)."""
    width = dim // PARTS
    used = min(width, 31)
    bits = max(1, min(16, 62 // used)) if used else 0
    step = np.maximum(1, (high - low + (1 << bits)) >> bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            n = batch.num_rows
            values = np.floor(np.asarray(batch.column(1).flatten(), np.float64) * SCALE).clip(-most, most).astype(np.int64).reshape(n, PARTS, width)
            for p in range(PARTS):
                v = values[:, p]
                near = (v[:, :used] - low[p, :used]) // step[p, :used] if used else v
                place = hilbert_index(near, bits) if used else np.zeros(n, np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(place), batch.column(0), flat], ["part", "place", "row", "v"])

    return run


def _packer(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted parts to flat blocks: rows and components, and their box, sums and count."""

    def block(part: int, rows: np.ndarray, v: np.ndarray) -> tuple:
        edge = lambda f: f(axis=0).tolist() if width else []
        return part, rows.tolist(), v.ravel().tolist(), edge(v.min), edge(v.max), edge(v.sum), len(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), *[pa.list_(pa.int64())] * 5, pa.int64())
        for batch in batches:
            part, rows = (batch.column(i).to_numpy() for i in (0, 1))
            v = np.asarray(batch.column(2).flatten(), np.int64).reshape(len(rows), width)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
            out = [block(int(part[a]), rows[a:b], v[a:b]) for lo, hi in zip(cuts, cuts[1:], strict=False) for a in range(lo, hi, BLOCK) for b in (min(a + BLOCK, hi),)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["part", "rows", "v", "low", "high", "sums", "n"])

    return run


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries that may be the nearest of a point in the box, ascending: those whose least distance
    from the box is no more than the least of all entries' greatest."""
    below, above = low - entries, entries - high
    least = (np.maximum(0, np.maximum(below, above)) ** 2).sum(1)
    greatest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(1)
    return np.flatnonzero(least <= greatest.min())


def nearest_entry(v: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each point, ties to the lower index, in whole numbers."""
    squared = ((v[:, None, :] - entries) ** 2).sum(2)
    code = squared.argmin(1)
    return code, squared[np.arange(len(v)), code]


def _summer(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round: (part, entry, sums, n) over the blocks of a task. A block with one entry on its
    shortlist gives its sums as they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books.shape[2]
        sums, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for part, flat, low, high, total, count in zip(*(c.to_pylist() if i in (0, 5) else [x.values.to_numpy() for x in c] for i, c in enumerate(batch.columns)), strict=True):
                some = shortlist(low, high, books[part])
                if len(some) == 1:
                    sums[part, some[0]] += total
                    n[part, some[0]] += count
                else:
                    v = flat.reshape(count, width)
                    code, _ = nearest_entry(v, books[part, some])
                    np.add.at(sums[part], some[code], v)
                    n[part] += np.bincount(some[code], minlength=books.shape[1])
        part, entry = np.nonzero(n)
        cells = [part.astype(np.int32), entry.astype(np.int32), n[part, entry]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cells), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _coder(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last assignment: (row, part, entry, squared distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows, flat, low, high in zip(*(c.to_pylist() if i == 0 else [x.values.to_numpy() for x in c] for i, c in enumerate(batch.columns)), strict=True):
                some = shortlist(low, high, books[part])
                code, error = nearest_entry(flat.reshape(len(rows), books.shape[2]), books[part, some])
                full = [rows, np.full(len(rows), part, np.int32), some[code].astype(np.int32), error]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in full], ["row", "part", "entry", "error"])

    return run


def refine(spark: SparkSession, blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after some rounds. The driver gets PARTS * ENTRIES sums a round, whatever the input."""
    for _ in range(rounds):
        each = blocks.select("part", "v", "low", "high", "sums", "n").mapInArrow(_summer(books), "part int, entry int, n long, sums array<long>")
        at = each.select("part", "entry", "n", F.posexplode("sums").alias("i", "s")).groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        books = books.copy()
        for r in at.collect():
            books[r["part"], r["entry"], r["i"]] = r["s"] // r["n"]
    return books


def compress(spark: SparkSession, vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Codes of eight parts, sixteen entries each, for every vector without nulls or non-finite components.

    Components are floor(4096 x). Each part is sorted by its place on a Hilbert curve and packed
    into flat blocks that store the parts' box, sums and count. In a round the box gives each block
    the entries that can be nearest to any of its points; if that is one entry the stored sums are
    taken, else the few entries are compared in whole numbers. Codebooks don't depend on how parts
    fall into blocks.

    All vectors must have one length, divisible by eight: the commonest (ties: the least). Others,
    if any, keep a row with code, error and label_error null and take no part. Components are held
    to a bound by which no sum of squares leaves 64 bits (2^30 / sqrt(length) after scaling; for 64
    dimensions vectors within 32768). Null vec_ids come last among the ids that start the
    codebooks, equal vec_ids go by their components. With fewer than 16 vectors the codebooks have
    as many entries. An empty table gives an empty result, other columns are ignored, repeated rows
    are kept.

    Returns vec_id, code, error, label_error, codebooks_sha256.
    """
    small_batches(spark)
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    kept = vectors.where(ok).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    kept = materialize(spark, kept.withColumn("row", F.monotonically_increasing_id()), "codes-vectors")
    lengths = kept.groupBy(F.size("embedding").alias("d")).count().where("d % 8 = 0").orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        empty = F.lit(None)
        return kept.select("vec_id", empty.cast("string").alias("code"), empty.cast("long").alias("error"), empty.cast("long").alias("label_error"), empty.cast("string").alias("codebooks_sha256"))
    dim = lengths[0]["d"]
    width, most = dim // PARTS, int((1 << 30) / max(1, dim) ** 0.5)
    usable = kept.where(F.size("embedding") == dim)
    first = usable.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    whole = np.floor(np.array([r["embedding"] for r in first], np.float64).reshape(len(first), dim) * SCALE).clip(-most, most).astype(np.int64)
    books = np.ascontiguousarray(whole.reshape(len(first), PARTS, width).transpose(1, 0, 2))

    spread = usable.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect() if width else []
    low, high = np.zeros((PARTS, width), np.int64), np.zeros((PARTS, width), np.int64)
    for r in spread:
        at = divmod(r["i"], width)
        low[at], high[at] = (int(np.clip(np.floor(r[c] * SCALE), -most, most)) for c in ("low", "high"))
    parts = usable.select("row", "embedding").mapInArrow(_splitter(dim, low, high, most), "part int, place long, row long, v array<long>")
    order = parts.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row")
    blocks = order.select("part", "row", "v").mapInArrow(_packer(width), "part int, rows array<long>, v array<long>, low array<long>, high array<long>, sums array<long>, n long")
    blocks = materialize(spark, blocks, "codes-blocks")
    books = refine(spark, blocks, books, rounds)

    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = blocks.select("part", "rows", "v", "low", "high").mapInArrow(_coder(books), "row long, part int, entry int, error long")
    joined = coded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "entry"))).alias("c"), F.sum("error").alias("error"))
    code = F.array_join(F.transform("c.entry", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    codes = materialize(spark, kept.select("vec_id", "label", "row").join(joined.select("row", code.alias("code"), "error"), "row", "left").drop("row"), "codes")
    release(spark, blocks, kept)
    of_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").isNull().alias("_none"), F.coalesce("label", F.lit(0)).alias("_label"), "label_error")
    known = F.when(F.col("code").isNotNull(), F.col("label_error")).alias("label_error")
    each = codes.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(0))}).join(of_label, ["_none", "_label"])
    return each.select("vec_id", "code", "error", known, F.when(F.col("code").isNotNull(), digest).alias("codebooks_sha256"))


def op12_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    return compress(spark, table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    floor = lambda a, b: f"(({a} - ((({a}) % {b} + {b}) % {b})) // {b})::bigint"
    steps = []
    near = lambda book: f"""select r, p, v, arg_min(e, (d, e)) as e, min(d) as d from (select x.r, x.p, x.v, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::bigint as d
  from x join {book} b on x.p = b.p) group by r, p, v"""  # noqa: E731
    for k in range(ROUNDS):
        steps.append(f"""a{k} as materialized ({near(f"b{k}")}),
m{k} as (select p, e, i, {floor("sum(v[i])", "count(*)")} as m from (select p, e, v, unnest(range(1, len(v) + 1)) as i from a{k}) group by p, e, i),
b{k + 1} as materialized (select b.p, b.e, coalesce(m.v, b.v) as v from b{k} b left join (select p, e, list(m order by i) as v from m{k} group by p, e) m on b.p = m.p and b.e = m.e)""")
    return f"""with k as materialized (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select r, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] as v from (select r, v, unnest(range({PARTS})) as p from k)),
b0 as materialized (select p, r - 1 as e, v from x where r <= {ENTRIES}),
{", ".join(steps)},
z as materialized ({near(f"b{ROUNDS}")}),
c as (select r, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from z group by r),
s as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as sha from b{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, sha as codebooks_sha256 from k join c on k.r = c.r, s"""


SQL = _sql()
