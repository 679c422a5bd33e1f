"""Dealing rows to work units and shards under limits of bytes and rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(df: DataFrame, group: str, order: Sequence[Column | str], size: Column, most_bytes: int, most_rows: int) -> DataFrame:
    """Add `unit`, from 0 within the group: rows in order fill a unit until the next one would take
    it over either limit; that row opens the next. A row over the limit by itself has a unit of its own.

    Where units end depends on all rows before, so a group's rows stream through one task in order;
    nothing of them is kept but two sums. Keep df narrow.
    """
    sized = df.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0)))
    columns = sized.schema.names

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, unit, rows, used = object(), 0, 0, 0
        for frame in frames:
            units = []
            for key, n in zip(frame[group], frame["_size"], strict=True):
                if key != now:
                    now, unit, rows, used = key, 0, 0, 0
                elif rows and (used + n > most_bytes or rows + 1 > most_rows):
                    unit, rows, used = unit + 1, 0, 0
                rows, used = rows + 1, used + n
                units.append(unit)
            yield frame[columns].assign(unit=units)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema)
    return sized.repartition(group).sortWithinPartitions(group, *order).mapInPandas(deal, f"{schema}, unit long").drop("_size")
