"""Streams of events, drained into tables and held against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.plans.registry import query
from docquarry.streaming import windows as W


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.stream_table(spark, sf_dir, "events")


def naive(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(W.drain(W.tumbling(events(spark, sf_dir), "1 day", "event_type")))


@query("""select time_bucket(interval 6 hour, ts) - to_hours(6 * k::integer) as start, event_type, count(*) as n from events, unnest([0, 1]) t(k) group by 1, 2""")
def stream_sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(W.drain(W.sliding(events(spark, sf_dir), "12 hours", "6 hours", "event_type")))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval 2 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g) select min(ts) as start, user_id, count(*) as n from s group by user_id, s""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(W.drain(W.sessions(events(spark, sf_dir), "2 hours", "user_id")))


@query("select count(*) as n, count(distinct event_id) as ids, 2 * count(*) as came from events")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice and stays once."""
    twice = events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = W.drain(W.deduplicated(twice, ["event_id"]), "append")
    return once.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids")).withColumn("came", F.lit(2) * F.col("n"))


@query()
def stream_stateful_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user, allowed and refused by five in any day; tests hold it against a plain loop."""
    counts = W.drain(W.limiter(events(spark, sf_dir), "user_id", 5, 86400), "update")
    return counts.groupBy(F.col("key").alias("user_id")).agg(F.max("allowed").alias("allowed"), F.max("refused").alias("refused"))
