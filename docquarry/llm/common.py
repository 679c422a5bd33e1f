"""What the corpus operators share: reading, shared intermediate tables, positions in a total order."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash() -> Column:
    """xxhash64 of the text, null as empty: with doc_id, the key of a row (rows that share it are equal)."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def row_key() -> list[Column]:
    """_id, _hash: the key of a row, without nulls (rows that share it are equal in doc_id and text)."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNull()).alias("_hash")]


def packed(docs: DataFrame) -> DataFrame:
    """(doc, _id, _hash): each row in one struct, so that no column of it clashes with another, and its key."""
    return docs.select(F.struct("*").alias("doc"), *row_key())


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("doc").getField(c).alias(c) for c in columns])


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="docquarry-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut in the lineage that outlives lost executors."""
    path = f"{shared_dir(spark)}/docquarry/{name}-{uuid.uuid4().hex}"
    # What was shuffled for it isn't read again: its files go with the end of the write.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote, when all that is made of them is written itself."""
    for table_ in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table_.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Most rows of an Arrow batch between the JVM and Python, of whole texts of any length.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS rows: batches of whole texts are what the
    memory of an executor and its Python workers goes by."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(run: Batches) -> Batches:
    """run, after which a worker gives its free memory back: workers outlive their tasks, and what each
    stage of a job left with them would add up in an executor."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # no glibc
            pass

    return whole


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A few rows of a batch at a time, so that few texts at once become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def positions(
    spark: SparkSession, df: DataFrame, order: list[str], name: str, size: str | None = None
) -> DataFrame:
    """Add `pos` (row number from 0 in the given order) and, with `size`, `before` (sum of the sizes
    of all earlier rows) and `total`.

    Rows are range-partitioned and written once; only one row a partition (its count and sum) takes
    part in the global prefix sum, so no task sees the whole table. Rows that tie in all of `order`
    are interchangeable. Keep df narrow: it is shuffled twice.
    """
    keys: list[Column | str] = [*order, F.monotonically_increasing_id()]
    cut = materialize(
        spark,
        df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()),
        name,
    )
    amount = F.col(size) if size else F.lit(0)
    totals = cut.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(amount).alias("_s"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_sizes"),
        F.sum("_s").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    if size:
        out = out.withColumn("_run", F.sum(size).over(inside))
    out = out.join(F.broadcast(offsets), "_part").withColumn("pos", F.col("_rows") + F.col("_row") - 1)
    if size:
        out = out.withColumn("before", F.col("_sizes") + F.col("_run") - F.col(size))
        return out.drop("_part", "_rows", "_sizes", "_row", "_run")
    return out.drop("_part", "_rows", "_sizes", "_row", "total")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, bounds) of rows that come sorted by their first `keys` columns, groups never cut:
    what a batch leaves open is held for the next. bounds: where groups begin, and the end."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            now = [np.concatenate(pair) for pair in zip(kept, now, strict=True)]
        if not len(now[0]):
            continue
        starts = np.flatnonzero(np.any([np.diff(c) != 0 for c in now[:keys]], axis=0)) + 1
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield [c[:last] for c in now], np.concatenate(([0], starts))
        kept = [c[last:] for c in now]
    if kept is not None and len(kept[0]):
        yield kept, np.array([0, len(kept[0])])
