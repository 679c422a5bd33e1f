"""Joins on ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, at: str, reach: int) -> DataFrame:
    """Pairs with equal keys and right.at in [left.start, left.start + reach].

    Points are dealt to buckets of width `reach`: a range meets two at most, so this is an
    equi-join on key and bucket rather than one on the key alone with all its pairs.
    """
    one, two = F.floor(F.col(start) / reach), F.floor((F.col(start) + reach) / reach)
    dealt = left.withColumn("_bucket", F.explode(F.sequence(one, two)))
    points = right.withColumn("_bucket", F.floor(F.col(at) / reach))
    return dealt.join(points, [*keys, "_bucket"]).where(F.col(at).between(F.col(start), F.col(start) + reach)).drop("_bucket")
