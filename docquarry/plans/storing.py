"""Writing: shards that go on from a ledger, pages upserted by variant, closures of containment."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.catalog import table
from docquarry.operators import graph as G
from docquarry.operators import shards
from docquarry.pagestore import PageStore
from docquarry.plans.registry import query
from docquarry.session import shared_dir

BYTES, ROWS = 100_000, 60

_STEP = f"d > 0 and (b + text_bytes > {BYTES} or r + row_count > {ROWS})"
_RUN = f"""select c.i, c.key, case when {_STEP} then shard + 1 else shard end, case when {_STEP} then text_bytes else b + text_bytes end,
 case when {_STEP} then row_count else r + row_count end, case when {_STEP} then 1 else d + 1 end"""
ASSIGNED_SQL = f"""with recursive docs as (select md5(doc_id::varchar) || doc_id as key, strlen(coalesce(text, '')) as text_bytes, 1 + length(coalesce(text, '')) // 2000 as row_count, lang from documents),
c1 as (select *, row_number() over (order by key) as i from docs where lang = 'en'),
w1(i, key, shard, b, r, d) as (select 0::bigint, '', 1::bigint, 0::bigint, 0::bigint, 0 union all {_RUN} from w1 join c1 c on c.i = w1.i + 1),
c2 as (select *, row_number() over (order by key) as i from docs where lang is distinct from 'en'),
w2(i, key, shard, b, r, d) as (select 0::bigint, '', shard, b, r, d from w1 where i = (select max(i) from w1) union all {_RUN} from w2 join c2 c on c.i = w2.i + 1)
"""


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """English documents first; then all, of which those keep their shards."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.md5(F.col("doc_id").cast("string")), F.col("doc_id").cast("string")).alias("key"), F.octet_length(F.coalesce("text", F.lit(""))).alias("text_bytes"),
        (F.floor(F.length(F.coalesce("text", F.lit(""))) / 2000) + 1).alias("row_count"), "lang",
    )
    none = spark.createDataFrame([], "key string, shard_index long")
    first, ledger = shards.assign(spark, spark.createDataFrame([], shards.LEDGER), docs.where("lang = 'en'"), none, BYTES, ROWS)
    return shards.assign(spark, ledger, docs, first, BYTES, ROWS)


@query(f"{ASSIGNED_SQL} select key, shard as shard_index from w1 where i > 0 union all select key, shard from w2 where i > 0")
def shards_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of documents by hash, of 100 kB or 60 rows, in two runs of which the second goes on from the first's ledger."""
    return _assigned(spark, sf_dir)[0]


@query(f"""{ASSIGNED_SQL}, s as (select key, shard from w1 where i > 0 union all select key, shard from w2 where i > 0)
select shard as shard_index, sum(text_bytes)::bigint as text_bytes, sum(row_count)::bigint as row_count, count(*) as doc_count,
 shard = (select max(shard) from s) and sum(text_bytes) <= {BYTES} and sum(row_count) <= {ROWS} as is_open from s join docs on s.key = docs.key group by 1""")
def shards_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after both runs: fill, and that only the last shard is open, if it has room."""
    return _assigned(spark, sf_dir)[1]


_PAGES = """with p as (select doc_id, regexp_replace(unnest(list_transform(range(0, greatest(length(coalesce(text, '')) - 1, 0) // 1000 + 1), lambda i: substr(coalesce(text, ''), (1000 * i + 1)::int, 1000))), '^\\s+|\\s+$', '', 'g') as text,
 unnest(range(1, greatest(length(coalesce(text, '')) - 1, 0) // 1000 + 2)) as page_id from documents)"""


@query(f"{_PAGES} select doc_id::varchar as file_hash, 'text' as extracted_by, page_id::int as page_id, text, strlen(text)::bigint as text_bytes from p where length(text) >= 2")
def pages_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 1000 characters, written three times: with English texts in capitals and each text
    twice as long, then as they are, then the same again, which writes nothing; then compacted."""
    store = PageStore(spark, f"{shared_dir(spark)}/docquarry/pages-{uuid.uuid4().hex}")

    def pages(text: F.Column) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_hash"), F.lit("text").alias("extracted_by"), F.coalesce(text, F.lit("")).alias("t"))
        cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("t") - 1, F.lit(0)) / 1000)), lambda i: F.substring(F.col("t"), (1000 * i + 1).cast("int"), F.lit(1000)))
        return docs.select("file_hash", "extracted_by", F.posexplode(cut).alias("page_id", "text")).withColumn("page_id", F.col("page_id") + 1)

    text = F.col("text")
    store.put(pages(F.when(F.col("lang") == "en", F.concat(F.upper(text), text)).otherwise(text)))
    store.put(pages(text))
    store.put(pages(text))
    store.compact()
    return store.pages()


_EDGES = """e(node, parent) as (select distinct 'doc ' || doc_id, 'source ' || source from documents where doc_id is not null and source is not null
union select distinct 'source ' || source, 'lang ' || lang from documents where source is not null and lang is not null union select distinct 'lang ' || lang, 'all' from documents where lang is not null)"""


@query(f"""with recursive {_EDGES}, up(node, ancestor, hops) as (select node, parent, 1 from e union select u.node, e.parent, u.hops + 1 from up u join e on u.ancestor = e.node)
select node, ancestor, min(hops)::int as hops, false as truncated from up group by 1, 2""")
def folder_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that holds a document: its source, the languages of the source, and all; a source has several parents."""
    docs = table(spark, sf_dir, "documents")
    named = lambda kind: F.concat(F.lit(f"{kind} "), F.col({"doc": "doc_id"}.get(kind, kind)).cast("string"))
    edges = docs.select(named("doc").alias("node"), named("source").alias("parent")).unionByName(docs.select(named("source").alias("node"), named("lang").alias("parent")).distinct())
    edges = edges.unionByName(docs.select(named("lang").alias("node"), F.lit("all").alias("parent")).distinct())
    return G.ancestors(edges.where("node is not null and parent is not null"))
