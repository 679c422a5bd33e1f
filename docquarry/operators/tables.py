"""Spreadsheet cells in long form (row_id, column_id, cell_text): typing, statistics, browsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpivot(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Non-empty cells of a wide table, columns numbered from 1."""
    cells = F.array(*[F.struct(F.lit(i).alias("column_id"), F.col(c).cast("string").alias("cell_text")) for i, c in enumerate(columns, 1)])
    return df.select(F.col(row_id).cast("long").alias("row_id"), F.explode(cells).alias("c")).select("row_id", "c.*").where("cell_text <> ''")


def cell_kind(text: Column) -> Column:
    """int (no leading zero, fits 64 bits), float (with a dot), date (ISO), else text."""
    whole = text.rlike("^-?(0|[1-9][0-9]{0,18})$") & text.try_cast("bigint").isNotNull()
    stamp = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$") & F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull()
    return F.when(whole, "int").when(text.rlike(r"^-?[0-9]+\.[0-9]+$"), "float").when(stamp, "date").otherwise("text")


def majority_kind(cells: DataFrame) -> DataFrame:
    """The most frequent kind of each column; a tie makes it text."""
    counts = cells.groupBy("column_id", "kind").agg(F.count("*").alias("n"))
    ranked = counts.groupBy("column_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "kind")))).alias("k"))
    tie = (F.size("k") > 1) & (F.get("k", F.lit(0))["n"] == F.get("k", F.lit(1))["n"])
    return ranked.select("column_id", F.when(tie, "text").otherwise(F.get("k", F.lit(0))["kind"]).alias("kind"))


def column_stats(cells: DataFrame) -> DataFrame:
    """Filled and distinct cells, least and greatest by number where both are numbers, else by text."""
    number = F.col("cell_text").try_cast("double")
    return cells.groupBy("column_id").agg(
        F.count("*").alias("non_empty"), F.countDistinct("cell_text").alias("distinct_cells"), F.min(number).alias("min_number"), F.max(number).alias("max_number"),
        F.min("cell_text").alias("min_text"), F.max("cell_text").alias("max_text"),
    )


def matching_rows(cells: DataFrame, column_id: int, test: Column) -> DataFrame:
    """Rows whose cell in a column passes a test, for semi-joins."""
    return cells.where((F.col("column_id") == column_id) & test).select("row_id").distinct()


def grid_page(cells: DataFrame, sort_column: int, columns: Sequence[int], offset: int, limit: int, descending: bool = False) -> DataFrame:
    """A window of rows, sorted by a column's numbers, then its text, then row_id; rows without the
    cell come last either way. Row ids are sorted narrow first, then only their cells are pivoted."""
    limit = max(1, min(limit, 200))
    keys = cells.where(F.col("column_id") == sort_column).select("row_id", F.col("cell_text").alias("_t"), F.col("cell_text").try_cast("double").alias("_n"))
    ids = cells.select("row_id").distinct().join(keys, "row_id", "left")
    by = F.desc_nulls_last if descending else F.asc_nulls_last
    order = [F.col("_t").isNull(), by("_n"), by("_t"), F.col("row_id")]
    top = ids.orderBy(*order).offset(offset).limit(limit)
    shown = top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long") + offset)
    wide = cells.join(F.broadcast(shown.select("row_id", "position")), "row_id").groupBy("position", "row_id").pivot("column_id", list(columns)).agg(F.first("cell_text"))
    return wide.select("position", "row_id", *[F.col(str(c)).alias(f"c{c}") for c in columns])


def column_letter(index: Column) -> Column:
    """A, B, ..., Z, AA, ..., XFD, ... of a column's number from 1: digits 1 to 26, without a zero."""
    state = lambda n, t: F.struct(n.cast("long").alias("n"), t.alias("t"))
    step = lambda s, _: F.when(s["n"] <= 0, s).otherwise(state(F.floor((s["n"] - 1) / 26), F.concat(F.char((s["n"] - 1) % 26 + 65), s["t"])))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), state(index, F.lit("")), step, lambda s: s["t"])


def excel_serial(serial: Column, from_1904: bool = False) -> Column:
    """Timestamp of a spreadsheet's day number; the 1900 system's 29 February 1900 doesn't exist."""
    days = serial + 1462 if from_1904 else F.when(serial < 60, serial + 1).otherwise(serial)
    return F.timestamp_seconds(F.round((days - 25569).cast("double") * 86400))
