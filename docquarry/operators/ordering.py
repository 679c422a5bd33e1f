"""Row numbers and running sums over a total order of a whole table, with no task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.staging import keep


def running(df: DataFrame, order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Add `pos`, the row's number from 0 in the order, and for each column of `sums` the sum of it
    over all rows before, as `<column>_before`.

    Rows are dealt to ranges of the order and written once; each range gives one row of totals, and
    only those are summed up in one place. Rows that tie in all of `order` may stand either way.
    """
    keys: list[Column | str] = [*order, F.monotonically_increasing_id()]
    cut = keep(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ordered")
    return _running(cut, order, sums)


def continued(kept: DataFrame, sums: Sequence[str]) -> DataFrame:
    """`<column>_before` for a table that has `pos`, and the `_part` that `running` dealt its rows to."""
    return _running(kept, ["pos"], sums, False)


def _running(cut: DataFrame, order: Sequence[str], sums: Sequence[str], numbered: bool = True) -> DataFrame:
    totals = cut.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(earlier), zero).alias("_n"), *[F.coalesce(F.sum(f"_s_{c}").over(earlier), zero).alias(f"_s_{c}") for c in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({"_row": F.row_number().over(Window.partitionBy("_part").orderBy(*order)), **{f"_r_{c}": F.sum(c).over(inside) for c in sums}})
    # One row a range: as many as the table has partitions.
    out = out.join(F.broadcast(offsets), "_part")
    added = {f"{c}_before": F.col(f"_s_{c}") + F.col(f"_r_{c}") - F.col(c) for c in sums}
    if numbered:
        added["pos"] = F.col("_n") + F.col("_row") - 1
    return out.withColumns(added).drop("_n", "_row", *[f"_s_{c}" for c in sums], *[f"_r_{c}" for c in sums])
