"""Vector search, fusion, floors and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.catalog import table
from docquarry.operators import hybrid as H
from docquarry.operators import search as S
from docquarry.plans.registry import query
from docquarry.plans.search import pages

QUERY_ID = 7
DOT = "list_sum(list_transform({a}, lambda v, i: v::double * {b}[i]::double))"
COS = f"{DOT.format(a='e.embedding', b='q.embedding')} / (sqrt({DOT.format(a='e.embedding', b='e.embedding')}) * sqrt({DOT.format(a='q.embedding', b='q.embedding')}))"
KNN = f"select e.vec_id, e.label, round({COS}, 9) as cosine from embeddings e, (select embedding from embeddings where vec_id = {QUERY_ID}) q order by cosine desc, e.vec_id limit {{k}}"


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_ID).first()["embedding"]


def nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return H.knn(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), k).select("vec_id", "label", "cosine")


@query(KNN.format(k=60))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir, 60)


LISTS = """l as (select 'price' as source, p_partkey as key, p_retailprice as score from part where p_size > 45 union all select 'size', p_partkey, p_size from part where p_retailprice > 1000
union all select 'price', p_partkey, p_retailprice - 1 from part where p_size > 45),
o as (select source, key, max(score) as s from l group by 1, 2), r as (select source, key, row_number() over (partition by source order by s desc, key) as r from o),
f as (select key, sum(1.0::double / (60 + r)) as rrf, string_agg(distinct source, ',' order by source) as sources from r group by 1)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    row = lambda df, source, score: df.select(F.lit(source).alias("source"), F.col("p_partkey").alias("key"), score.cast("double").alias("score"))
    large, dear = part.where("p_size > 45"), part.where("p_retailprice > 1000")
    lists = row(large, "price", F.col("p_retailprice")).unionByName(row(dear, "size", F.col("p_size"))).unionByName(row(large, "price", F.col("p_retailprice") - 1))
    return H.rrf(lists, "source", "key", "score")


@query(f"with {LISTS} select key, round(rrf, 9) as rrf, sources from f order by rrf desc, key limit 50")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("key", F.round("rrf", 9).alias("rrf"), "sources").orderBy(F.desc("rrf"), "key").limit(50)


@query(f"""with k as ({KNN.format(k=60)}), o as (select *, vec_id % 3 > 0 as fit, row_number() over (partition by label, vec_id % 3 > 0 order by cosine desc, vec_id) as own from k),
r as (select *, fit and own <= 2 as kept from o), n as (select *, row_number() over (partition by label, kept order by cosine desc, vec_id) as nth, count(*) filter (kept) over (partition by label) as has, count(*) filter (kept) over () as all_kept from r),
f as (select *, row_number() over (order by cosine desc, vec_id) as place from n where not kept and nth <= 4 - has)
select vec_id, label, cosine from n where kept union all select vec_id, label, cosine from f where place <= 20 - all_kept""")
def per_kind_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty of the nearest, at least two deserving and at most four of each label."""
    return H.per_kind_floor(nearest(spark, sf_dir, 60), "label", [F.desc("cosine"), F.col("vec_id")], 20, 2, 4, F.col("vec_id") % 3 > 0)


TERMS = ("license", "apache", "mit")


@query("""with q(query) as (values ('license'), ('apache'), ('mit')), t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as toks from documents),
h as (select query, doc_id, row_number() over (partition by query order by len(list_filter(toks, lambda x: x = query)) desc, doc_id) as r from t, q where list_contains(toks, query))
select doc_id, round(sum(1.0::double / (60 + r)), 9) as rrf, string_agg(query, ',' order by query) as matched_queries from h group by 1""")
def cross_query_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several queries' hits fused, with the queries that each matched."""
    index = pages(spark, sf_dir).where(S.any_of(F.col("toks"), TERMS))
    hits = index.select("doc_id", F.explode(F.array(*[F.struct(F.lit(t).alias("query"), F.size(S.positions(F.col("toks"), t)).alias("tf")) for t in TERMS])).alias("h")).where("h.tf > 0")
    return H.rrf(hits.select("doc_id", "h.query", "h.tf"), "query", "doc_id", "tf").select("doc_id", F.round("rrf", 9).alias("rrf"), F.col("sources").alias("matched_queries"))


@query(f"""with k as (select vec_id as key, row_number() over (order by cosine desc, vec_id) as r from ({KNN.format(k=60)})),
t as (select doc_id as key, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x = 'the')) as tf from documents),
b as (select key, row_number() over (order by tf desc, key) as r from (select * from t where tf > 0 order by tf desc, key limit 60)),
f as (select key, sum(1.0::double / (60 + r)) as rrf, string_agg(source, ',' order by source) as sources from (select 'text' as source, * from b union all select 'vector', * from k) group by 1)
select key, round(rrf, 9) as rrf, sources from f order by rrf desc, key limit 20""")
def hybrid_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 60 by words and by vectors, fused; an id stands for a document in both."""
    words = pages(spark, sf_dir).select(F.col("doc_id").alias("key"), F.size(S.positions(F.col("toks"), "the")).cast("double").alias("score")).where("score > 0").orderBy(F.desc("score"), "key").limit(60)
    vectors = nearest(spark, sf_dir, 60).select(F.col("vec_id").alias("key"), F.col("cosine").alias("score"))
    both = words.withColumn("source", F.lit("text")).unionByName(vectors.withColumn("source", F.lit("vector")))
    return H.rrf(both, "source", "key", "score").select("key", F.round("rrf", 9).alias("rrf"), "sources").orderBy(F.desc("rrf"), "key").limit(20)


@query("""with s as (select item_id, length(text) as cost, sum(length(text) + 120) over (order by item_id rows unbounded preceding)::bigint as spent from benchmark) select item_id, spent from s where spent <= 5000""")
def payload_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in order while their texts and envelopes keep within 5000 characters."""
    items = table(spark, sf_dir, "benchmark")
    return H.within_budget(items, ["item_id"], F.length("text") + 120, 5000, 120).select("item_id", F.col("spent").cast("long").alias("spent"))


@query(f"""with k as ({KNN.format(k=10)}) select k.vec_id, k.cosine, d.source from k left join documents d on d.doc_id = k.vec_id""")
def vector_hit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits with what the chunk table knows of them."""
    hits = nearest(spark, sf_dir, 10)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source").join(F.broadcast(hits), "vec_id", "right").select("vec_id", "cosine", "source")


@query()
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of all documents by the offline stand-in."""
    return pages(spark, sf_dir).select("doc_id", H.hash_embedding(F.col("toks"), 16).alias("embedding"))
