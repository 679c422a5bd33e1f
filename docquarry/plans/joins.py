"""Versioned rows, joins, set operations and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.catalog import table
from docquarry.operators.intervals import range_join
from docquarry.operators.ordering import running
from docquarry.plans.registry import query
from docquarry.versioned import argmax, final, n_per_group, unprocessed


@query("""select user_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events)
where r = 1 and event_type <> 'error'""")
def final_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, unless it is a tombstone (an error stands for one)."""
    newest = final(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return newest.select("user_id", "event_type", "value")


@query("""select user_id, event_type, value from (select user_id, event_type, value, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events)
where r = 1 and event_type <> 'error'""")
def argmax_having_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = argmax(table(spark, sf_dir, "events"), ["user_id"], ["event_type", "value"], ["ts", "event_id"])
    return newest.where("event_type <> 'error'")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 3")
def limit_n_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n_per_group(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def antijoin_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unprocessed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("select count(*) as unplanned from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def count_unplanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unprocessed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).agg(F.count("*").alias("unplanned"))


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where toxic = 1)")
def semi_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("select c_custkey from customer except select o_custkey from orders where o_totalprice > 450000")
def orphan_setdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed keys that nothing live reaches."""
    live = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(live)


@query("""select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.clicks, 0) as clicks, coalesce(b.errors, 0) as errors
from (select user_id, count(*) as clicks from events where event_type = 'click' and value > 50 group by 1) a
full join (select user_id, count(*) as errors from events where event_type = 'error' and value > 50 group by 1) b on a.user_id = b.user_id""")
def full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value > 50")
    side = lambda kind, name: events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias(name))
    zero = F.lit(0).cast("long")
    return side("click", "clicks").join(side("error", "errors"), "user_id", "full_outer").select("user_id", F.coalesce("clicks", zero).alias("clicks"), F.coalesce("errors", zero).alias("errors"))


@query("""select 'document' as kind, doc_id as id from documents where n_chars > 20000 union all select 'page', page_id from pages where length(html) > 3000
union all select 'conversation', conv_id from (select distinct conv_id from conversations where turn > 4)""")
def union_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several sources, tagged with their kind."""
    parts = [
        table(spark, sf_dir, "documents").where("n_chars > 20000").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id")),
        table(spark, sf_dir, "pages").where("length(html) > 3000").select(F.lit("page").alias("kind"), F.col("page_id").alias("id")),
        table(spark, sf_dir, "conversations").where("turn > 4").select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id")).distinct(),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select n_nationkey as nationkey from nation where n_regionkey < 3 intersect select c_nationkey from customer where c_acctbal > 9500")
def intersect_permitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    permitted = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("nationkey"))
    return permitted.intersect(table(spark, sf_dir, "customer").where("c_acctbal > 9500").select("c_nationkey"))


@query("select p_partkey from part except select l_partkey from lineitem where l_quantity > 45")
def except_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(current, "p_partkey", "left_anti").distinct()


@query("""select a.event_id as first_id, b.event_id as second_id from events a join events b on a.user_id = b.user_id
and b.ts > a.ts and b.ts <= a.ts + interval 1 hour where a.event_type = 'view' and b.event_type = 'purchase'""")
def range_join_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within an hour after a view of the same user."""
    events = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("first_id"), F.col("s").alias("from_s"))
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("second_id"), F.col("s").alias("at_s"))
    hour = 3_600_000_000
    near = range_join(views, buys, ["user_id"], "from_s", "at_s", hour)
    return near.where(F.col("at_s") > F.col("from_s")).select("first_id", "second_id")


@query("""select e.event_id, (select l.event_id from events l where l.user_id = e.user_id and l.event_type = 'signup' and l.ts <= e.ts order by l.ts desc, l.event_id desc limit 1) as signup_id
from events e where e.event_type = 'purchase'""")
def asof_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup at or before each purchase: one sort by user and time, no join."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase"))
    order = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "signup", 0).otherwise(1), "event_id")
    signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
    last = F.last(signup, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("signup_id", last).where("event_type = 'purchase'").select("event_id", "signup_id")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where (l_orderkey, l_linenumber) > (500, 2) order by l_orderkey, l_linenumber, l_partkey limit 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.struct("l_orderkey", "l_linenumber") > F.struct(F.lit(500).cast("long"), F.lit(2))
    return table(spark, sf_dir, "lineitem").where(after).select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(50)


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey
join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey group by 1""")
def join_inner_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "nation")}
    joined = (
        t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select c_custkey, count(o_orderkey) as n_orders from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by 1")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"))


@query("select s_suppkey from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity = 50)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "lineitem").where("l_quantity = 50"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select c_nationkey, s_nationkey from (select distinct c_nationkey from customer where c_acctbal > 9900) full join (select distinct s_nationkey from supplier where s_acctbal > 8000) on c_nationkey = s_nationkey")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select("c_nationkey").distinct()
    right = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select("s_nationkey").distinct()
    return left.join(right, F.col("c_nationkey") == F.col("s_nationkey"), "full_outer")


@query("""with x as (select p_brand, count(*) as parts from part group by 1), y as (select p_brand, count(distinct l_orderkey) as orders from part join lineitem on l_partkey = p_partkey group by 1),
z as (select p_brand, max(p_retailprice) as top_price from part group by 1) select x.p_brand, parts, coalesce(orders, 0) as orders, top_price from x left join y using (p_brand) left join z using (p_brand)""")
def multi_source_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several sources, each grouped by the key before the joins, so that none multiplies another."""
    part = table(spark, sf_dir, "part")
    orders = part.join(table(spark, sf_dir, "lineitem"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.countDistinct("l_orderkey").alias("orders"))
    base = part.groupBy("p_brand").agg(F.count("*").alias("parts"), F.max("p_retailprice").alias("top_price"))
    return base.join(orders, "p_brand", "left").select("p_brand", "parts", F.coalesce("orders", F.lit(0).cast("long")).alias("orders"), "top_price")


@query("""select p_brand as term_id, min(p_type) as display from part group by 1""")
def term_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display string of each term; on conflict the least."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("term_id")).agg(F.min("p_type").alias("display"))


@query("""select conv_id, turn, dense_rank() over (partition by role order by conv_id) as ordinal from conversations""")
def dense_row_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of a conversation among its role's: distinct pairs are numbered over their whole order, less the pairs of earlier roles."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    placed = running(turns.select("role", "conv_id").distinct(), ["role", "conv_id"]).select("role", "conv_id", "pos")
    first = placed.groupBy("role").agg(F.min("pos").alias("first"))
    ordinals = placed.join(first, "role").select("role", "conv_id", (F.col("pos") - F.col("first") + 1).alias("ordinal"))
    return turns.join(ordinals, ["role", "conv_id"]).select("conv_id", "turn", "ordinal")


@query("""select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 600000000 preceding and current row) as recent from events""")
def sliding_request_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the user in the ten minutes up to each."""
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    recent = F.count("*").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-600_000_000, 0))
    return events.select("event_id", recent.alias("recent"))


@query("""select conv_id, list_aggr(list_sort(list(distinct role)), 'string_agg', ',') as roles from conversations group by 1""")
def distinct_union_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the sets that several detectors give a key."""
    sets = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.array(F.first("role")).alias("found"))
    return sets.groupBy("conv_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), ",").alias("roles"))
