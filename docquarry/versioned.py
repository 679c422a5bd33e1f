"""Versioned rows: an insert is an upsert by key, a deletion is a row that says so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def final(df: DataFrame, keys: Sequence[str], version: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """The newest row of each key (greatest `version`, which should be a total order), unless it is deleted."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(v) for v in version])
    out = df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    return out.where(~F.coalesce(deleted, F.lit(False))) if deleted is not None else out


def argmax(df: DataFrame, keys: Sequence[str], values: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The newest row's values by aggregation: no sort, partial maxima before the shuffle."""
    newest = F.max_by(F.struct(*values), F.struct(*version)).alias("_v")
    return df.groupBy(*keys).agg(newest).select(*keys, "_v.*")


def n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each key; Spark prunes to n a partition before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def unprocessed(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a mark in the table of processed keys."""
    return df.join(done.select(*keys), list(keys), "left_anti")
