"""Intake of files, ledgers and batches, and what a browser asks of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.catalog import table
from docquarry.functions import entities as N
from docquarry.functions import types
from docquarry.operators import entities as E
from docquarry.operators import packing
from docquarry.plans.extraction import only
from docquarry.plans.processing import PACKED
from docquarry.plans.registry import query


@query("select doc_id, case when strlen(text) <= 4096 then 'inline' else 'store' end as place from documents")
def small_blob_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents up to 4096 bytes stay in the table, larger ones go to the object store."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.octet_length("text") <= 4096, "inline").otherwise("store").alias("place"))


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("size"))


@query(PACKED.format(bytes=50000, rows=10, order="doc_id"))
def file_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in batches of ten or 50 kB."""
    return packing.pack(sized(spark, sf_dir), "source", ["doc_id"], F.col("size"), 50000, 10).select("source", "doc_id", "unit")


@query(PACKED.format(bytes=25000, rows=32, order="doc_id") + " where unit > 0")
def text_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for an embedding service, 32 or 25 kB together; all batches but the first of a source."""
    return packing.pack(sized(spark, sf_dir), "source", ["doc_id"], F.col("size"), 25000, 32).where("unit > 0").select("source", "doc_id", "unit")


LEDGER = PACKED.format(bytes=100000, rows=25, order="md5(doc_id::varchar), doc_id")


@query(f"""select source, unit, count(*) as docs, sum(strlen(text))::bigint as text_bytes, unit = max(unit) over (partition by source) as is_open
from ({LEDGER}) join documents using (source, doc_id) group by 1, 2""")
def shard_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of a packing: their documents and bytes, and that the last of each is open."""
    packed = packing.pack(sized(spark, sf_dir), "source", [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], F.col("size"), 100000, 25)
    shards = packed.groupBy("source", "unit").agg(F.count("*").alias("docs"), F.sum("size").cast("long").alias("text_bytes"))
    last = shards.groupBy("source").agg(F.max("unit").alias("last"))
    return shards.join(last, "source").select("source", "unit", "docs", "text_bytes", (F.col("unit") == F.col("last")).alias("is_open"))


@query("""with recursive w as (select o_custkey as g, o_orderkey as id, length(o_orderkey::varchar) + 2 as size, row_number() over (partition by o_custkey order by o_orderkey) as r from orders),
p(g, r, id, unit, used) as (select g, r, id, 0::bigint, size from w where r = 1 union all
select p.g, w.r, w.id, case when p.used + w.size > 40 then p.unit + 1 else p.unit end, case when p.used + w.size > 40 then w.size else p.used + w.size end from p join w on w.g = p.g and w.r = p.r + 1)
select g as customer, unit, string_agg(id::varchar, ', ' order by id) as keys from p group by 1, 2""")
def in_list_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order numbers as IN lists of at most 40 bytes."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("id"))
    packed = packing.pack(keys, "customer", ["id"], F.length(F.col("id").cast("string")) + 2, 40, 1 << 30)
    ids = F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string"))
    return packed.groupBy("customer", "unit").agg(F.array_join(ids, ", ").alias("keys"))


@query("""select d.doc_id, case when k.doc_id is null then 3 when d.n_chars = k.n_chars then 2 else 3 end as seen_in, k.doc_id is not null and d.n_chars = k.n_chars as confirmed
from documents d left join (select doc_id, n_chars + (doc_id % 4 = 0)::int as n_chars from documents where doc_id % 3 > 0) k on k.doc_id = d.doc_id""")
def touch_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that a scan confirms is touched, else the sweep of deletions would take it; changed
    and new ones are written by the ingest after it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    known = docs.where("doc_id % 3 > 0").select("doc_id", (F.col("n_chars") + (F.col("doc_id") % 4 == 0).cast("int")).alias("known"))
    same = F.coalesce(F.col("n_chars") == F.col("known"), F.lit(False))
    return docs.join(known, "doc_id", "left").select("doc_id", F.when(same, 2).otherwise(3).alias("seen_in"), same.alias("confirmed"))


@query("""with u as (select page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[.]([A-Za-z0-9]+)$', 1)) as ext from pages)
select ext, count(*) as n, case when ext in ('html', 'htm') then 'text/html' when ext = 'pdf' then 'application/pdf' when ext = 'zip' then 'application/zip' when ext = 'csv' then 'text/csv' when ext = 'txt' then 'text/plain' else 'application/octet-stream' end as mime from u group by 1""")
def mime_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by the end of the name."""
    ext = F.lower(F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "[.]([A-Za-z0-9]+)$", 1))
    return table(spark, sf_dir, "pages").groupBy(ext.alias("ext")).agg(F.count("*").alias("n")).withColumn("mime", types.mime_of_extension(F.col("ext")))


@query("""with t as (select doc_id, case when doc_id % 2 = 0 then 'From: a@x\nTo: b@x\nSubject: ' else 'From here: ' end || text as text from documents)
select doc_id, len(list_filter(string_split(text, chr(10))[1:20], lambda l: regexp_matches(l, '^(From|To|Cc|Subject|Date|Message-ID|Received|MIME-Version): '))) >= 3 as mail from t""")
def sniff_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that begin with a block of mail headers."""
    head = F.when(F.col("doc_id") % 2 == 0, "From: a@x\nTo: b@x\nSubject: ").otherwise("From here: ")
    return table(spark, sf_dir, "documents").select("doc_id", types.is_mail(F.concat(head, "text")).alias("mail"))


@query("""with l as (select 'new' as list, page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, length(html) as n, row_number() over (order by page_id) as r from pages
union all select 'long', page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), length(html), row_number() over (order by length(html) desc, page_id) from pages),
b as (select list, host, min(r) as best from l group by 1, 2), k as (select list, host, row_number() over (partition by list order by best) as r from b)
select host, round(sum(1.0::double / (60 + r)), 9) as rrf, (select arg_max(page_id, (n, -page_id)) from l x where x.host = k.host) as page_id from k group by host""")
def rrf_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of two page lists fused by their ranks; each shows its longest page."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.length("html").alias("n"))
    best = pages.groupBy("host").agg(F.min("page_id").alias("new"), F.min(F.struct(-F.col("n"), F.col("page_id"))).alias("long"))
    ranked = best.select("host", F.explode(F.array(F.struct(F.lit("new").alias("list"), F.struct(F.lit(0).alias("n"), F.col("new").alias("p")).alias("key")), F.struct(F.lit("long").alias("list"), F.struct(F.col("long.col1").alias("n"), F.col("long.page_id").alias("p")).alias("key")))).alias("x"), F.col("long.page_id").alias("page_id"))
    rank = F.row_number().over(Window.partitionBy("x.list").orderBy("x.key"))
    return ranked.withColumn("r", rank).groupBy("host", "page_id").agg(F.round(F.sum(1 / (60 + F.col("r"))), 9).alias("rrf"))


@query("""select event_type, count(distinct ts::date) as days, count(distinct ts::date) > 100000 as partial from events group by 1""")
def day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that have any row, and whether there are more than are listed."""
    days = F.countDistinct(F.to_date("ts"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(days.alias("days"), (days > 100000).alias("partial"))


@query("""with s as (select event_type, count(*) as done, epoch_us(max(ts)) - epoch_us(min(ts)) as span, (select count(*) from events) as total from events group by 1)
select event_type, total - done as remaining, case when span > 0 then round((total - done) * (span / 1000000.0) / done, 3) end as eta_s from s""")
def eta_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each stage, at the rate of what is done."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    events = table(spark, sf_dir, "events")
    stages = events.groupBy("event_type").agg(F.count("*").alias("done"), (us(F.max("ts")) - us(F.min("ts"))).alias("span")).crossJoin(F.broadcast(events.agg(F.count("*").alias("total"))))
    left = F.col("total") - F.col("done")
    return stages.select("event_type", left.alias("remaining"), F.when(F.col("span") > 0, F.round(left * (F.col("span") / 1000000.0) / F.col("done"), 3)).alias("eta_s"))


@query("select conv_id as sheet, count(*) - 1 as rows, max(length(text)) as widest from conversations group by 1 having count(*) > 1")
def table_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each sheet without its header."""
    sheets = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("sheet"))
    return sheets.agg((F.count("*") - 1).alias("rows"), F.max(F.length("text")).alias("widest")).where("rows > 0")


@query("""select conv_id, turn, text from conversations where turn > 0 qualify row_number() over (partition by conv_id order by turn) <= 2""")
def below_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two rows under the header row."""
    rows = table(spark, sf_dir, "conversations").where("turn > 0").withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.where("r <= 2").select("conv_id", "turn", "text")


@query(r"""with c as (select distinct unnest(string_split_regex(text, '[ \t\r\n]+')) as code from conversations union select distinct '"' || c_mktsegment || '" 0' from customer union select distinct o_orderpriority from orders union
select distinct '[' || p_brand || ']' || p_size || '\' || left(p_type, 1) from part), b as (select code, regexp_replace(lower(code), '"[^"]*"|\\.|_.|\[[^\]]*\]', '', 'g') as b from c where code is not null)
select code, not contains(b, 'general') and regexp_matches(b, '[dmyhs]') as is_date from b""")
def format_is_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of turns, and strings made of customers, orders and parts, would show dates as number formats."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "[ \t\r\n]+")).alias("code"))
    quoted = table(spark, sf_dir, "customer").select(F.concat(F.lit('"'), "c_mktsegment", F.lit('" 0')).alias("code"))
    bracketed = table(spark, sf_dir, "part").select(F.concat(F.lit("["), "p_brand", F.lit("]"), F.col("p_size").cast("string"), F.lit("\\"), F.left("p_type", F.lit(1))).alias("code"))
    codes = words.unionByName(quoted).unionByName(bracketed).unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("code"))).where("code is not null").distinct()
    return codes.select("code", N.is_date_format(F.col("code")).alias("is_date"))


@query(r"""with m as (select doc_id, regexp_replace(unnest(regexp_extract_all(text, '\b(?:USD|EUR|GBP|JPY|CHF) ?[0-9]{1,3}(?:,[0-9]{3})*(?:[.][0-9]{2})?\b')), '[ ,]', '', 'g') as v from documents)
select doc_id, v as value, case when v like 'JPY%' then (case when contains(v, '.') then null else substr(v, 4)::decimal(18,0)::bigint::varchar end) else (substr(v, 4)::decimal(18,2) * 100)::bigint::varchar end as minor, count(*) as n from m group by 1, 2""")
def money_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in the currency's smallest unit, exactly."""
    hits = E.scan(table(spark, sf_dir, "documents"), only("money.iso_code"))
    minor = N.minor_units(F.substr("value", F.lit(4)), N.exponent(F.substring("value", 1, 3)))
    return hits.groupBy("doc_id", "value").agg(F.count("*").alias("n")).withColumn("minor", minor)


@query(r"""with m as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,24}')) as m from documents)
select 'email:' || lower(m) as facet, count(distinct doc_id) as docs, count(*) as n from m where not contains(m, '..') and instr(m, '@') <= 65 group by 1""")
def facet_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities counted by the key of their value, whatever its case."""
    hits = E.scan(table(spark, sf_dir, "documents"), only("email.basic"))
    return hits.groupBy(N.facet_key(F.col("kind"), F.col("value")).alias("facet")).agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("n"))


@query(r"""with m as (select doc_id, unnest(regexp_extract_all(text, '[+][1-9][0-9 ().-]{6,18}[0-9]')) as m from documents), v as (select doc_id, '+' || regexp_replace(m, '[^0-9]', '', 'g') as value from m)
select doc_id, value, count(*) as n from v where length(value) between 9 and 16 group by 1, 2""")
def scan_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scan(table(spark, sf_dir, "documents"), only("phone.e164")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query(r"""with m as (select doc_id, unnest(regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')) as m from documents)
select doc_id, m as value, count(*) as n from m where m not like '000%' and m not like '666%' and m not like '9%' and substr(m, 5, 2) <> '00' and substr(m, 8) <> '0000' group by 1, 2""")
def scan_national_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scan(table(spark, sf_dir, "documents"), only("national_id.us_ssn")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query("""with c as (select s_suppkey, 'CSQU' || lpad((s_suppkey * 30511 % 1000000)::varchar, 6, '0') || (s_suppkey % 10) as code from supplier),
v as (select s_suppkey, code, list_transform(range(1, 11), lambda i: case when substr(code, i, 1) between '0' and '9' then substr(code, i, 1)::int else ord(substr(code, i, 1)) - 55 + (ord(substr(code, i, 1)) - 56) // 10 end * (1 << (i - 1)::int)) as x from c)
select s_suppkey, (list_sum(x) % 11) % 10 = substr(code, 11, 1)::int as ok from v""")
def checksum_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container codes by ISO 6346."""
    key = F.col("s_suppkey")
    code = F.concat(F.lit("CSQU"), F.lpad((key * 30511 % 1000000).cast("string"), 6, "0"), (key % 10).cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", N.iso_6346(code).alias("ok"))


@query("""with c as (select p_partkey, lpad((p_partkey * 12347 % 1000000000)::varchar, 9, '0') as t from part)
select p_partkey, (3 * (substr(t, 1, 1)::int + substr(t, 4, 1)::int + substr(t, 7, 1)::int) + 7 * (substr(t, 2, 1)::int + substr(t, 5, 1)::int + substr(t, 8, 1)::int) + substr(t, 3, 1)::int + substr(t, 6, 1)::int + substr(t, 9, 1)::int) % 10 = 0 and t <> '000000000' as ok from c""")
def checksum_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank routing numbers."""
    return table(spark, sf_dir, "part").select("p_partkey", N.aba(F.lpad((F.col("p_partkey") * 12347 % 1000000000).cast("string"), 9, "0")).alias("ok"))


@query(r"""with h as (select doc_id, text, instr(text, '@') as p from documents where instr(text, '@') > 0)
select doc_id, regexp_matches(lower(substr(text, greatest(p - 40, 1), p - greatest(p - 40, 1))), '\b(?:mail|email|contact|write)\b') as cued from h""")
def context_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cue stands shortly before the first at sign."""
    hits = table(spark, sf_dir, "documents").withColumn("at", F.instr("text", "@")).where("at > 0")
    return hits.select("doc_id", N.near_cue(F.col("text"), F.col("at"), ["mail", "email", "contact", "write"]).alias("cued"))


@query("""with h as (select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', ''), '/+$', '') as p from pages where contains(lower(html), 'nav')),
n as (select page_id, '/' || array_to_string(list_filter(string_split(p, '/'), lambda x: x <> ''), '/') as path from h) select path, count(*) as hits, min(page_id) as first_page from n group by 1""")
def hit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the path that each is found at."""
    hits = table(spark, sf_dir, "pages").where(F.contains(F.lower("html"), F.lit("nav")))
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-zA-Z]+://", ""), "[?#].*$", "")
    return hits.groupBy(types.normalise_path(bare).alias("path")).agg(F.count("*").alias("hits"), F.min("page_id").alias("first_page"))


@query("""select doc_id, upper(source) || '/' || lang as label, n_chars * 2 as doubled from documents""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and a table function that SQL users call by name."""
    from docquarry import sqlfunctions

    sqlfunctions.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("_intake_documents")
    return spark.sql("select d.doc_id, dq_label(d.source, d.lang) as label, t.doubled from _intake_documents d, lateral dq_doubled(d.n_chars) t")
