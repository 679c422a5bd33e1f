"""Operational analytics over event logs, and other aggregates.

Events stand for task runs: event_type is the task, value its seconds, user_id the document or
worker, an error event a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.catalog import table
from docquarry.plans.registry import query


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


@query("""select event_type as task, count(*) as runs, round(sum(value), 3) as busy_s, round(avg(value), 6) as mean_s, round(quantile_cont(value, 0.95), 6) as p95_s,
max(value) as max_s, count(*) filter (value > 90) as slow, round(100 * sum(value) / sum(sum(value)) over (), 6) as share,
epoch_us(max(ts)) - epoch_us(min(ts)) as wall_us, round(sum(value) * 1000000 / (epoch_us(max(ts)) - epoch_us(min(ts))), 9) as parallelism from events group by 1""")
def task_time_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_task = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(
        F.count("*").alias("runs"), F.sum("value").alias("s"), F.avg("value").alias("m"), F.percentile("value", F.lit(0.95)).alias("p"), F.max("value").alias("max_s"),
        F.count_if(F.col("value") > 90).alias("slow"), (F.max(micros("ts")) - F.min(micros("ts"))).alias("wall_us"),
    )
    share = 100 * F.col("s") / F.sum("s").over(Window.partitionBy())  # one row a task
    return by_task.select(
        "task", "runs", F.round("s", 3).alias("busy_s"), F.round("m", 6).alias("mean_s"), F.round("p", 6).alias("p95_s"), "max_s", "slow",
        F.round(share, 6).alias("share"), "wall_us", F.round(F.col("s") * 1000000 / F.col("wall_us"), 9).alias("parallelism"),
    )


@query("""select event_type as task, sum(greatest(0, least(epoch_us(ts) + (value * 1000000)::bigint, 1705363200000000) - greatest(epoch_us(ts), 1705276800000000)))::bigint as busy_us
from (select *  replace (floor(value) as value) from events) group by 1""")
def task_live_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time that runs spend within a window: the overlap of each with it."""
    t0, t1 = 1705276800000000, 1705363200000000
    end = micros("ts") + F.floor("value") * 1000000
    overlap = F.greatest(F.lit(0).cast("long"), F.least(end, F.lit(t1)) - F.greatest(micros("ts"), F.lit(t0)))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(F.sum(overlap).alias("busy_us"))


@query("""select event_type as task, round(sum(value), 3) as in_flight from (select event_type, user_id, value, row_number() over (partition by event_type, user_id order by ts desc, event_id desc) as r
from events) where r = 1 group by 1""")
def inflight_latest_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels: each worker's newest sample, then the sum."""
    newest = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return newest.groupBy(F.col("event_type").alias("task")).agg(F.round(F.sum("v"), 3).alias("in_flight"))


@query("""select user_id % 7 as task, count(*) as failures, count(distinct user_id) as documents, max(ts) as last_seen, arg_max(event_id, ts) as sample from events where event_type = 'error' group by 1""")
def failures_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    return errors.groupBy((F.col("user_id") % 7).alias("task")).agg(
        F.count("*").alias("failures"), F.countDistinct("user_id").alias("documents"), F.max("ts").alias("last_seen"), F.max_by("event_id", "ts").alias("sample")
    )


@query("""select user_id as document, string_agg(distinct h::varchar, ',' order by h::varchar) as tasks, count(*) as failures from (select *, hour(ts) as h from events where event_type = 'error') group by 1""")
def failures_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    return errors.groupBy(F.col("user_id").alias("document")).agg(
        F.array_join(F.array_sort(F.collect_set(F.hour("ts").cast("string"))), ",").alias("tasks"), F.count("*").alias("failures")
    )


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by 1, 2")
def usage_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("select user_id, count(*) as n from events group by 1 order by 2 desc, 1 limit 20")
def usage_top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)


@query("""select user_id, count(*) as calls, count(*) filter (event_type = 'error') as errors, round(count(*) filter (event_type = 'error') / count(*)::double, 6) as error_rate,
round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, max(value) as top from events group by 1""")
def api_stats_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.count_if(F.col("event_type") == "error")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("calls"), failed.alias("errors"), F.round(F.try_divide(failed, F.count("*")), 6).alias("error_rate"),
        F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.max("value").alias("top"),
    )


@query("""with r as (select event_type, value, ts, row_number() over (partition by event_type order by ts desc, event_id desc) as r from events),
a as (select event_type as stage, sum(value) as items, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::double as span from r where r <= 100 group by 1)
select stage, round(items / span, 9) as rate, round(100000 / (items / span), 3) as eta_s from a where span > 0""")
def eta_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items a second over the last hundred events of a stage, and the time for a hundred thousand."""
    order = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(order)).where("r <= 100")
    span = (F.max(micros("ts")) - F.min(micros("ts"))) / 1000000
    rates = last.groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("items"), span.alias("span")).where("span > 0")
    rate = F.col("items") / F.col("span")
    return rates.select("stage", F.round(rate, 9).alias("rate"), F.round(100000 / rate, 3).alias("eta_s"))


@query("""select source, count(*) as documents, count(l.doc_id) as labelled, round(count(l.doc_id) / count(*)::double, 6) as done from documents d left join labels l on d.doc_id = l.doc_id group by 1""")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("m"))
    return table(spark, sf_dir, "documents").join(marks, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("documents"), F.count("m").alias("labelled"), F.round(F.count("m") / F.count("*"), 6).alias("done")
    )


@query("""select source, count(*) as blobs, sum(bytes)::bigint as bytes, sum(docs)::bigint as docs from
(select source, md5(text) as h, max(strlen(text)) as bytes, count(*) as docs from documents group by 1, 2) group by 1""")
def collection_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and bytes of a dataset, equal contents once."""
    blobs = table(spark, sf_dir, "documents").groupBy("source", F.md5("text").alias("h")).agg(F.max(F.octet_length("text")).alias("b"), F.count("*").alias("d"))
    return blobs.groupBy("source").agg(F.count("*").alias("blobs"), F.sum("b").cast("long").alias("bytes"), F.sum("d").alias("docs"))


@query("""select role as entity, max(n)::bigint as hits from (select conv_id, role, sum(length(text)) as n from conversations group by 1, 2) group by 1""")
def entity_rollup_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed over segments, then the greatest over variants."""
    inner = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sum(F.length("text")).alias("n"))
    return inner.groupBy(F.col("role").alias("entity")).agg(F.max("n").alias("hits"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)")
def rollup_cube_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("select event_type, round(count(*) * 100.0::double / sum(count(*)) over (), 6) as share from events group by 1")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.select("event_type", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query()
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("""select event_type, min(h)::bigint as first_hour, max(h)::bigint as last_hour, count(distinct h) as hours from (select event_type, hour(ts) as h from events) group by 1""")
def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with their least and greatest page."""
    h = F.hour("ts").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min(h).alias("first_hour"), F.max(h).alias("last_hour"), F.countDistinct(h).alias("hours"))


@query("""select user_id, count(*) filter (event_type = 'view') as views, count(*) filter (event_type = 'purchase') as purchases, round(sum(value) filter (event_type = 'purchase'), 3) as spent from events group by 1""")
def per_user_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.col("event_type") == k
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind("view")).alias("views"), F.count_if(kind("purchase")).alias("purchases"), F.round(F.sum(F.when(kind("purchase"), F.col("value"))), 3).alias("spent")
    )


@query("""select task, runs, round(p50, 6) as p50, round(p99, 6) as p99 from (select event_type as task, count(*) as runs, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.99) as p99
from events group by 1 having count(*) >= 50)""")
def time_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(F.count("*").alias("runs"), p(0.5).alias("p50"), p(0.99).alias("p99")).where("runs >= 50")


@query("""select user_id % 10 as operation, count(*) as n, count(*) filter (event_type = 'error') as failed, count(distinct user_id) as documents,
count(distinct user_id) filter (event_type = 'error') as failed_documents, count(*) filter (event_type = 'error') > 0.2 * count(*) as alert from events group by 1""")
def operation_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("operation")).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("failed"), F.countDistinct("user_id").alias("documents"),
        F.countDistinct(F.when(failed, F.col("user_id"))).alias("failed_documents"), (F.count_if(failed) > 0.2 * F.count("*")).alias("alert"),
    )


@query("""select user_id, event_id from (select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) as r from events) where r = 1""")
def slowest_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query("""select event_id, ts from events where ts > (select max(ts) from events) - interval 2 day""")
def ttl_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a retention of two days keeps, counted from the newest."""
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("newest"))
    return events.join(F.broadcast(newest), events.ts > F.col("newest") - F.expr("interval 2 days")).select("event_id", "ts")
