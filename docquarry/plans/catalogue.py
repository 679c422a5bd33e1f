"""Names, ids, listings and other small queries around the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.catalog import table
from docquarry.functions import text as T
from docquarry.functions import types
from docquarry.plans.graphs import url_paths
from docquarry.plans.registry import query


@query("""select 'source' as field, value, ('0x' || substr(md5('source' || chr(31) || value), 1, 15))::bigint as id from (select distinct source as value from documents)
union all select 'lang', value, ('0x' || substr(md5('lang' || chr(31) || value), 1, 15))::bigint from (select distinct lang as value from documents)""")
def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of two fields with ids that follow from them."""
    docs = table(spark, sf_dir, "documents")
    terms = [docs.select(F.lit(f).alias("field"), F.col(f).alias("value")).distinct() for f in ("source", "lang")]
    return terms[0].unionByName(terms[1]).select("field", "value", T.term_id(F.col("field"), F.col("value")).alias("id"))


@query("select distinct source as value from documents where source not in (select source from documents where n_chars > 25000)")
def stale_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("value")).distinct().join(docs.where("n_chars > 25000").select(F.col("source").alias("value")), "value", "left_anti")


@query("select doc_id, md5(source || '|' || doc_id || '|text|1') as row_id from documents")
def page_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic ids, so that writing a page again replaces it."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat_ws("|", "source", "doc_id", F.lit("text"), F.lit("1"))).alias("row_id"))


@query("""select n_nationkey as id, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' as row from nation""")
def raw_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any table's rows as JSON."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("row"))


@query("select p_partkey, substr(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) as slug from part")
def collection_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("select p_brand as blob, arg_min(p_name, lower(p_name) || chr(0) || p_name) as name from part group by 1")
def primary_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a content's names the least whatever its case, in its own case."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("blob")).agg(F.min_by("p_name", F.struct(F.lower("p_name"), F.col("p_name"))).alias("name"))


@query("""select conv_id, turn, role from conversations c where not (role = 'user' and exists (select 1 from conversations d where d.conv_id = c.conv_id and d.role = 'system'))""")
def variant_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw variants are passed over where the document has a parsed one."""
    parsed = F.max((F.col("role") == "system").cast("int")).over(Window.partitionBy("conv_id"))
    rows = table(spark, sf_dir, "conversations").withColumn("parsed", parsed)
    return rows.where((F.col("role") != "user") | (F.col("parsed") == 0)).select("conv_id", "turn", "role")


@query("select page_id, '/' || host as path from (select page_id, regexp_extract(regexp_replace(url, '^[a-zA-Z]+://', ''), '^([^/?#]*)', 1) as host from pages) where host <> ''")
def path_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_paths(spark, sf_dir).select("page_id", F.element_at(types.ancestors(F.col("path")), 2).alias("up"), "path").select("page_id", F.coalesce("up", "path").alias("path"))


@query("select l_orderkey, l_linenumber from lineitem where l_quantity > 49 and l_discount > 0.09")
def cell_and_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_discount > 0.09").select("l_orderkey", "l_linenumber")


@query("""with t as (select doc_id, len(regexp_extract_all(lower(text), 'license')) as n from documents), c as (select item_id as doc_id, len(regexp_extract_all(lower(text), 'the')) as n from benchmark)
select doc_id, sum(n)::bigint as items from (select * from t union all select * from c) group by 1 having sum(n) > 0""")
def document_itemcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a search in a document's text and in its table cells together."""
    text = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(F.lower("text"), F.lit("license")).alias("n"))
    cells = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.regexp_count(F.lower("text"), F.lit("the")).alias("n"))
    return text.unionByName(cells).groupBy("doc_id").agg(F.sum("n").cast("long").alias("items")).where("items > 0")


@query("""with p as (select page_id, '/' || array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', ''), '/'), lambda x: x <> ''), '/') as path from pages)
select page_id, path from p where contains(path, '1') and len(string_split(path, '/')) > 2""")
def folder_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with a needle at any depth below the root's folders."""
    paths = url_paths(spark, sf_dir)
    return paths.where(F.contains("path", F.lit("1")) & (F.size(types.ancestors(F.col("path"))) > 1))


@query("select conv_id, turn, case when length(text) <= 40 then text else regexp_replace(substr(text, 1, 40), '\\s+\\S*\\z', '') end as short from conversations")
def truncate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.truncate_words(F.col("text"), 40).alias("short"))


@query("""select conv_id, count(*) filter (role = 'user') as asked, count(*) filter (role = 'assistant') as answered, sum(length(text)) filter (role = 'assistant')::bigint as answer_chars from conversations group by 1""")
def chat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("asked"), F.count_if(answer).alias("answered"), F.sum(F.when(answer, F.length("text"))).cast("long").alias("answer_chars")
    )


@query("""select event_id, count(*) over (w range between 3600000000 preceding and current row) as hour_n, count(*) over (w range between 21600000000 preceding and current row) as six_n,
count(*) over (w range between 86400000000 preceding and current row) > 40 as refused from events window w as (partition by user_id order by epoch_us(ts))""")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests within several windows before each, over one sort."""
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    over = lambda s: F.count("*").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-s * 1_000_000, 0))
    return events.select("event_id", over(3600).alias("hour_n"), over(21600).alias("six_n"), (over(86400) > 40).alias("refused"))


@query("select distinct lower(p_type) as kind from part")
def dedupe_casefold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lower("p_type").alias("kind")).distinct()


@query("select page_id, replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://(?:www[.])?', ''), '[?#].*$', ''), '/+$', ''), '/', ' > ') as shown from pages")
def display_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.display_url(F.col("url")).alias("shown"))


@query(r"""with l as (select page_id, case when page_id % 2 = 0 then 'https://r.example/go?url=' || url_encode(url) || '&s=2' else url end as link from pages),
t as (select page_id, link, regexp_extract(link, '[?&](?:url|u|q)=(https?(?:://|%3A%2F%2F)[^&#]*)', 1) as inside from l) select page_id, case when inside <> '' then url_decode(inside) else link end as url from t""")
def unwrap_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other page's URL within a redirect, and taken out of it again."""
    wrapped = F.concat(F.lit("https://r.example/go?url="), F.url_encode("url"), F.lit("&s=2"))
    link = F.when(F.col("page_id") % 2 == 0, wrapped).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.unwrap_redirect(link).alias("url"))


@query("select conv_id, (min(turn) filter (role = 'assistant'))::varchar as first_answer from conversations group by 1")
def header_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as pairs of name and value in JSON; the first value of a name."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    pairs = F.to_json(F.transform(turns, lambda t: F.array(t["role"], t["turn"].cast("string"))))
    convs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(pairs.alias("pairs"))
    return convs.select("conv_id", T.first_header(F.col("pairs"), "Assistant").alias("first_answer"))


@query("""with k as (select n_nationkey, n_regionkey, list_sort([lower(substr(n_name, 1, 3)), 'eng']) as l from nation)
select n_nationkey, case when n_regionkey > 0 then 'ocr:e' || n_regionkey || ':' || array_to_string(l, '+') else 'raw_text' end as key, case when n_regionkey > 0 then 'e' || n_regionkey end as engine, case when n_regionkey > 0 then array_to_string(l, ',') end as languages from k""")
def variant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of OCR variants made of an engine and languages, and taken apart again."""
    made = T.variant_key(F.concat(F.lit("e"), F.col("n_regionkey").cast("string")), F.array(F.lower(F.substring("n_name", 1, 3)), F.lit("eng")))
    keys = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") > 0, made).otherwise("raw_text").alias("key")).withColumn("v", T.parse_variant_key(F.col("key")))
    return keys.select("n_nationkey", "key", "v.engine", F.array_join("v.languages", ",").alias("languages"))


@query("select item_id, md5('passage: ' || trim(regexp_replace(text, '\\s+', ' ', 'g'))) as digest from benchmark")
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(T.embedding_input(F.col("text"), "passage")).alias("digest"))


@query("select user_id from events where event_type = 'view' and value > 90 intersect all select user_id from events where event_type = 'click' and value > 90")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value > 90")
    return events.where("event_type = 'view'").select("user_id").intersectAll(events.where("event_type = 'click'").select("user_id"))


@query("select user_id from events where event_type = 'view' and value > 90 except all select user_id from events where event_type = 'click' and value > 90")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value > 90")
    return events.where("event_type = 'view'").select("user_id").exceptAll(events.where("event_type = 'click'").select("user_id"))


@query("select l_returnflag, l_linestatus, l_linenumber, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linenumber), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupingSets([["l_returnflag", "l_linestatus"], ["l_linenumber"], []], "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("""select l_orderkey, l_linenumber, l_partkey, next_part from (select l_orderkey, l_linenumber, l_partkey, lead(l_partkey) over w as next_part, row_number() over w as r from lineitem
window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)) where r = 1""")
def best_parent_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first edge of each node by confidence, with the one that would be next."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lead("l_partkey").over(w).alias("next_part"), F.row_number().over(w).alias("r"))
    return rows.where("r = 1").drop("r")


@query("""select source, n, n >= 3 as ready, least(n, 5) as shown from (select source, count(*) filter (n_chars > 10000) as n from documents group by 1)""")
def stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 10000).alias("n"))
    return counts.select("source", "n", (F.col("n") >= 3).alias("ready"), F.least("n", F.lit(5).cast("long")).alias("shown"))
