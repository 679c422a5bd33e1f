"""Tables written for a while to the folder that driver and executors share: cuts in the lineage that outlive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from docquarry.session import shared_dir


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go with the end of its write, as nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back."""
    path = f"{shared_dir(df.sparkSession)}/docquarry/{name}-{uuid.uuid4().hex}"
    with passing_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop(*tables: DataFrame) -> None:
    """Delete kept tables, when what is made of them is kept itself."""
    for t in tables:
        delete(t.sparkSession, t.kept_at)
