"""Structured Streaming over event tables.

Each function takes a streaming (or static) DataFrame with an event time and returns one; `drain`
runs a stream over what its source holds and gives the rows back as a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.session import shared_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str, event_time: str = "ts") -> DataFrame:
    """A Parquet table as a stream of its files, with the event time as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    path = f"{sf_dir}/{name}.parquet*"  # a glob, since a stream reads folders; no other table is called so
    return spark.readStream.schema(schema).parquet(path).withColumn(event_time, F.col(event_time).cast("timestamp"))


def tumbling(events: DataFrame, width: str, *by: str, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, width: str, slide: str, *by: str, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, *by: str, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), *by, "n")


def deduplicated(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def limiter(events: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """(key, allowed, refused) counts: a request passes if fewer than `limit` passed in the seconds
    before it. State is the times that passed within the window, `limit` of them at most."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        passed, allowed, refused = state.get if state.exists else ([], 0, 0)
        times = pd.concat([f["ts"] for f in frames]).sort_values()
        for t in times.map(lambda x: int(x.timestamp())).tolist():
            passed = [p for p in passed if p > t - seconds]
            if len(passed) < limit:
                passed.append(t)
                allowed += 1
            else:
                refused += 1
        state.update((passed, allowed, refused))
        yield pd.DataFrame({"key": [k[0]], "allowed": [allowed], "refused": [refused]})

    return events.groupBy(key).applyInPandasWithState(step, "key long, allowed long, refused long", "passed array<long>, allowed long, refused long", "update", "NoTimeout")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run over all that the source holds now, then stop; the result as a table, written batch by
    batch to the folder that all executors share. In complete mode the last batch is the result."""
    at = f"{shared_dir(stream.sparkSession)}/docquarry/drained-{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/rows" if mode == "complete" else f"{at}/rows/batch={batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/progress").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    found = stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")
    return found.select(*stream.columns)
