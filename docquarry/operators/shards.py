"""Shards of bounded bytes and rows, filled in order: greedy packing without a loop over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.ordering import continued, running
from docquarry.staging import drop, keep

LEDGER = "shard_index long, text_bytes long, row_count long, doc_count long, is_open boolean"


def _reach(rows: DataFrame, size: str, most: int) -> DataFrame:
    """(pos, end): the first row that a unit beginning at pos has no room for by one limit. Sums up
    to each row's end, and the sums that a unit beginning at a row may reach, are sorted together;
    how many of the former come before one of the latter is where that unit ends."""
    ends = rows.select((F.col(f"{size}_before") + F.col(size)).alias("value"), F.lit(0).alias("ask"), F.lit(1).cast("long").alias("one"), F.lit(None).cast("long").alias("from"))
    asks = rows.select((F.col(f"{size}_before") + most).alias("value"), F.lit(1).alias("ask"), F.lit(0).cast("long").alias("one"), F.col("pos").alias("from"))
    sorted_ = running(ends.unionByName(asks), ["value", "ask"], ["one"])
    return sorted_.where("ask = 1").select(F.col("from").alias("pos"), F.col("one_before").alias(f"{size}_end"))


def _leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pos, end) of a range of rows in order to (pos, out): the first row outside of the range on the way from each."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if got:
        pos, at = (np.concatenate(c) for c in zip(*got, strict=True))
        after = pos[-1] + 1
        while (inside := np.flatnonzero(at < after)).size:
            at = at.copy()
            at[inside] = at[at[inside] - pos[0]]
        yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(at)], ["pos", "out"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pos, end, entry) of a range of rows in order to the rows at which units begin; entry: the first of them."""
    got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if got:
        pos, end, entry = (np.concatenate(c) for c in zip(*got, strict=True))
        starts = []
        at = int(entry[0])
        while at <= pos[-1]:
            starts.append(at)
            at = int(end[at - pos[0]])
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64())], ["pos"])


def filled(df: DataFrame, order: list[str], size: str, weight: str, most_bytes: int, most_rows: int) -> DataFrame:
    """Add `unit`, from 0: rows in order fill a unit until the next would take it over the bytes
    (`size`) or rows (`weight`) allowed; that row begins the next. A row over a limit has its own unit.

    Where the unit that begins at a row would end is a pointer. Within a range of rows pointers are
    followed to where they leave it, by doubling; the rows where any way enters a range are few, as
    ways soon meet, and the pointers between those are doubled by joins until all that the first row
    reaches are known. Then each range follows its one way again. A range of rows fits a task; no
    task sees all rows, and rounds go by the logarithm of the units.
    """
    rows = keep(running(df, order, [size, weight]), "packing-rows")
    reach = _reach(rows, size, most_bytes).join(_reach(rows, weight, most_rows), "pos")
    ends = rows.select("pos", "_part").join(reach, "pos").select("pos", "_part", F.greatest(F.col("pos") + 1, F.least(f"{size}_end", f"{weight}_end")).alias("end"))
    # As many partitions as ranges, each range within one: a range is what a task follows.
    ends = keep(ends.repartitionByRange("pos").sortWithinPartitions("pos").withColumn("_part", F.spark_partition_id()), "packing-ends")
    left = keep(ends.groupBy("_part").applyInArrow(_whole(_leave, ["pos", "end"]), "pos long, out long"), "packing-exits")
    entries = left.select(F.col("out").alias("pos")).distinct().unionByName(df.sparkSession.createDataFrame([(0,)], "pos long")).distinct()
    jumps = keep(left.join(entries, "pos", "left_semi"), "packing-jumps")
    reached, known = keep(df.sparkSession.createDataFrame([(0,)], "pos long"), "packing-reached"), 1
    while True:
        more = keep(reached.unionByName(reached.join(jumps, "pos").select(F.col("out").alias("pos"))).distinct(), "packing-reached")
        drop(reached)
        reached, before, known = more, known, more.count()
        if known == before:
            break
        far = keep(jumps.join(jumps.select(F.col("pos").alias("out"), F.col("out").alias("_far")), "out").select("pos", F.col("_far").alias("out")), "packing-jumps")
        drop(jumps)
        jumps = far
    entered = ends.join(reached, "pos").groupBy("_part").agg(F.min("pos").alias("entry"))
    starts = ends.join(entered, "_part").groupBy("_part").applyInArrow(_whole(_walk, ["pos", "end", "entry"]), "pos long")
    marked = rows.join(starts.withColumn("_first", F.lit(1).cast("long")), "pos", "left").withColumn("_first", F.coalesce("_first", F.lit(0).cast("long")))
    out = keep(continued(keep(marked, "packing-marked"), ["_first"]).withColumn("unit", F.col("_first_before") + F.col("_first") - 1), "packing-units")
    drop(rows, ends, left, jumps, reached)
    return out.drop("_first", "_first_before", "_part", f"{size}_before", f"{weight}_before")


def _whole(follow, columns: list[str]):
    """A function of a range's Arrow table, in the order of the rows."""

    def run(table: pa.Table) -> pa.Table:
        batches = table.select(columns).sort_by("pos").combine_chunks().to_batches()
        return pa.Table.from_batches(list(follow(iter(batches))))

    return run


def assign(spark: SparkSession, ledger: DataFrame, candidates: DataFrame, existing: DataFrame, most_bytes: int, most_rows: int) -> tuple[DataFrame, DataFrame]:
    """Deal documents to shards: (key, shard_index) of all, and the ledger after that.

    `existing` (key, shard_index) stays as it is and isn't counted again; `candidates` (key,
    text_bytes, row_count) without such an assignment fill shards in order of their key. The first
    go on in the ledger's open shard of the greatest index, if there is one; sealed shards stay
    sealed, and new ones are numbered on. A shard is sealed when the next document would take it
    over either limit or when it is over one; a document counts at least one row, and no bytes
    below none.
    """
    now = ledger.agg(F.max("shard_index").alias("last"), F.max(F.when(F.col("is_open"), F.col("shard_index"))).alias("open")).first()
    used = ledger.where(F.col("shard_index") == now["open"]).first() if now["open"] is not None else None
    begun = used is not None and used["doc_count"] > 0
    new = candidates.join(existing.select("key"), "key", "left_anti").select(
        F.lit(1).alias("_late"), "key", F.greatest(F.col("text_bytes"), F.lit(0)).cast("long").alias("text_bytes"), F.greatest(F.col("row_count"), F.lit(1)).cast("long").alias("row_count")
    )
    if begun:  # what the open shard holds stands first, as one row
        held = spark.createDataFrame([(0, None, used["text_bytes"], used["row_count"])], new.schema)
        new = held.unionByName(new)
    first = now["open"] if used is not None else (now["last"] or 0) + 1
    after = (now["last"] or 0) + 1
    units = filled(new, ["_late", "key", "text_bytes", "row_count"], "text_bytes", "row_count", most_bytes, most_rows)
    index = F.when(F.col("unit") == 0, F.lit(first)).otherwise(F.col("unit") + (after - 1 if used is not None else after))
    dealt = units.where("_late = 1").select("key", index.cast("long").alias("shard_index"), "text_bytes", "row_count")
    added = dealt.groupBy("shard_index").agg(F.sum("text_bytes").alias("b"), F.sum("row_count").alias("r"), F.count("*").alias("d"))
    both = ledger.join(added, "shard_index", "full")
    total = lambda a, b: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("long")
    sums = both.select("shard_index", total("text_bytes", "b").alias("text_bytes"), total("row_count", "r").alias("row_count"), total("doc_count", "d").alias("doc_count"), "is_open", F.col("b").isNotNull().alias("filled"))
    last = added.agg(F.max("shard_index").alias("_last"))
    room = (F.col("text_bytes") <= most_bytes) & (F.col("row_count") <= most_rows)
    touched = F.col("filled") | (F.col("shard_index") == F.lit(now["open"]))
    open_ = F.when(F.col("_last").isNull() | ~F.coalesce(touched, F.lit(False)), F.coalesce("is_open", F.lit(False))).otherwise((F.col("shard_index") == F.col("_last")) & room)
    after_ = sums.crossJoin(F.broadcast(last)).select("shard_index", "text_bytes", "row_count", "doc_count", open_.alias("is_open"))
    return existing.select("key", "shard_index").unionByName(dealt.select("key", "shard_index")), after_
