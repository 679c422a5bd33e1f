"""Entities by rules, and their check digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.catalog import table
from docquarry.functions import checksums as C
from docquarry.functions import text as T
from docquarry.functions import wallets as W
from docquarry.operators import entities as E
from docquarry.plans.registry import query

#: Candidates by kind from a part's key, most of them invalid.
IDS = {
    "iban": ("'DE' || lpad((k % 97)::varchar, 2, '0') || lpad((k * 7919)::varchar, 18, '0')", "concat('DE', lpad(cast(k % 97 as string), 2, '0'), lpad(cast(k * 7919 as string), 18, '0'))"),
    "lei": ("lpad((k * 7919)::varchar, 20, '0')", "lpad(cast(k * 7919 as string), 20, '0')"),
    "isin": ("'US' || lpad((k * 977)::varchar, 10, '0')", "concat('US', lpad(cast(k * 977 as string), 10, '0'))"),
    "imo": ("lpad((k * 977 % 10000000)::varchar, 7, '0')", "lpad(cast(k * 977 % 10000000 as string), 7, '0')"),
    "orcid": ("lpad((k * 7919)::varchar, 16, '0')", "lpad(cast(k * 7919 as string), 16, '0')"),
    "luhn": ("lpad((k * 977)::varchar, 16, '0')", "lpad(cast(k * 977 as string), 16, '0')"),
    "damm": ("k::varchar", "cast(k as string)"),
    "mod1110": ("lpad(k::varchar, 6, '0')", "lpad(cast(k as string), 6, '0')"),
}
_DIGITS = "list_transform(string_split({0}, ''), lambda x: x::bigint)"
_LUHN = "list_sum(list_transform({0}, lambda x, i: case when (len({0}) - i) % 2 = 1 then (case when x * 2 > 9 then x * 2 - 9 else x * 2 end) else x end)) % 10 = 0"
_FOLD = "list_reduce(list_prepend({1}::bigint, {0}), lambda p, x: {2})"
IDS_SQL = {
    "iban": "(substr(id, 5) || '1314' || substr(id, 3, 2))::hugeint % 97 = 1", "lei": "id::hugeint % 97 = 1", "isin": _LUHN.format(_DIGITS.format("'3028' || substr(id, 3)")), "luhn": _LUHN.format(_DIGITS.format("id")),
    "imo": f"(list_sum(list_transform({_DIGITS.format('left(id, 6)')}, lambda x, i: x * (8 - i))) % 10) = right(id, 1)::bigint",
    "orcid": f"(12 - {_FOLD.format(_DIGITS.format('left(id, 15)'), 0, '(p + x) * 2 % 11')}) % 11 = right(id, 1)::bigint",
    "damm": f"{_FOLD.format(_DIGITS.format('id'), 0, chr(39) + C.DAMM.replace(' ', '') + chr(39) + '[(p * 10 + x + 1)::int]::bigint')} = 0",
    "mod1110": f"(11 - {_FOLD.format(_DIGITS.format('left(id, 5)'), 10, '(case when (p + x) % 10 = 0 then 10 else (p + x) % 10 end) * 2 % 11')}) % 10 = right(id, 1)::bigint",
}


@query(" union all ".join(f"select '{kind}' as kind, id, {IDS_SQL[kind]} as ok from (select {made[0]} as id from (select p_partkey as k from part))" for kind, made in IDS.items()))
def checksum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validators on numbers made of parts' keys: some are valid by chance."""
    tests = {"iban": C.iban, "lei": C.mod_97, "isin": C.isin, "imo": C.imo, "orcid": C.mod_11_2, "luhn": C.luhn, "damm": C.damm, "mod1110": C.mod_11_10}
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    each = keys.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.expr(made[1]).alias("id")) for kind, made in IDS.items()])).alias("c")).select("c.*")
    ok = F.lit(None).cast("boolean")
    for kind, test in tests.items():
        ok = F.when(F.col("kind") == kind, test(F.col("id"))).otherwise(ok)
    return each.select("kind", "id", ok.alias("ok"))


@query("""with d as (select p_partkey, list_transform(string_split((p_partkey * 7919 + 10000000)::varchar, ''), lambda x: x::integer) as g from part)
select p_partkey, list_sum(list_transform(g, lambda x, i: case when (len(g) - i) % 2 = 1 then (case when x * 2 > 9 then x * 2 - 9 else x * 2 end) else x end)) % 10 = 0 as ok from d""")
def checksum_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.luhn((F.col("p_partkey") * 7919 + 10000000).cast("string")).alias("ok"))


@query("select p_partkey, (p_partkey * 7919 + 10000000) % 97 = 1 as ok from part")
def checksum_mod97(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.mod_97((F.col("p_partkey") * 7919 + 10000000).cast("string")).alias("ok"))


@query("""with d as (select p_partkey, lpad((p_partkey * 977 % 10000000)::varchar, 7, '0') as t from part)
select p_partkey, (substr(t, 1, 1)::int * 7 + substr(t, 2, 1)::int * 6 + substr(t, 3, 1)::int * 5 + substr(t, 4, 1)::int * 4 + substr(t, 5, 1)::int * 3 + substr(t, 6, 1)::int * 2) % 10 = substr(t, 7, 1)::int as ok from d""")
def checksum_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lpad((F.col("p_partkey") * 977 % 10000000).cast("string"), 7, "0")
    return table(spark, sf_dir, "part").select("p_partkey", C.imo(text).alias("ok"))


def only(*rule_ids: str) -> tuple[E.Rule, ...]:
    return tuple(r for r in E.RULES if r.rule_id in rule_ids)


@query(r"""with m as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,24}')) as m from documents)
select doc_id, regexp_extract(m, '^([^@]*@)', 1) || lower(regexp_extract(m, '@(.*)$', 1)) as value, count(*) as n from m where not contains(m, '..') and instr(m, '@') <= 65 group by 1, 2""")
def scan_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scan(table(spark, sf_dir, "documents"), only("email.basic")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query(r"""with m as (select doc_id, unnest(regexp_extract_all(text, '\b[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}\b')) as m from documents)
select doc_id, m as value, count(*) as n from m where len(list_filter(string_split(m, '.'), lambda o: o::int > 255 or regexp_matches(o, '^0[0-9]'))) = 0 group by 1, 2""")
def scan_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scan(table(spark, sf_dir, "documents"), only("network.ip")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query(r"""with m as (select doc_id, replace(replace(unnest(regexp_extract_all(text, '\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b')), ' ', ''), '-', '') as m from documents),
g as (select doc_id, m, list_transform(string_split(m, ''), lambda x: x::integer) as g from m)
select doc_id, m as value, count(*) as n from g where list_sum(list_transform(g, lambda x, i: case when (len(g) - i) % 2 = 1 then (case when x * 2 > 9 then x * 2 - 9 else x * 2 end) else x end)) % 10 = 0 group by 1, 2""")
def scan_card_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scan(table(spark, sf_dir, "documents"), only("bank.payment_card")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


NOTES = [
    (1, "Pay to GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33 by 2024-02-29, not 2023-02-29."), (2, "LEI 5493001KJTIIGC8Y1R12, ISIN US0378331005, vessel IMO 9074729 and IMO 9074728."),
    (3, "See CVE-2021-44228, doi 10.1000/182 and 0000-0002-1825-0097 from 00:1A:2B:3C:4D:5E."), (4, "Paid USD 1,234.50 and EUR 20 on 2024-01-02, mail Jane.Doe@Example.ORG."), (5, "nothing here"),
]


def notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTES, "doc_id long, text string")


@query(r"""with m as (select doc_id, regexp_replace(upper(unnest(regexp_extract_all(text, '\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b'))), '[^0-9A-Z]', '', 'g') as v from documents),
g as (select doc_id, v, array_to_string(list_transform(string_split(substr(v, 5) || substr(v, 1, 4), ''), lambda c: case when c between '0' and '9' then c else (ord(c) - 55)::varchar end), '') as digits from m where length(v) between 15 and 34)
select doc_id, v as value, count(*) as n from g where list_reduce(list_transform(string_split(digits, ''), lambda x: x::bigint), lambda a, b: (a * 10 + b) % 97) = 1 group by 1, 2""")
def scan_iban_mod97(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scan(table(spark, sf_dir, "documents"), only("bank.iban")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query(r"""with m as (select doc_id, unnest(regexp_extract_all(text, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b')) as v from documents)
select doc_id, v as value, count(*) as n from m where try_cast(v as date) is not null and substr(v, 1, 4)::int between 1800 and 2100 group by 1, 2""")
def scan_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scan(table(spark, sf_dir, "documents"), only("date.iso8601")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query(r"""with m as (select doc_id, regexp_replace(unnest(regexp_extract_all(text, '\b(?:USD|EUR|GBP|JPY|CHF) ?[0-9]{1,3}(?:,[0-9]{3})*(?:[.][0-9]{2})?\b')), '[ ,]', '', 'g') as v from documents),
a as (select doc_id, substr(v, 1, 3) as c, substr(v, 4)::decimal(18,2) as x from m)
select doc_id, c || ':' || case when x < 10 then '<10' when x < 100 then '10-100' when x < 1000 then '100-1000' when x < 10000 then '1000-10000' when x < 100000 then '10000-100000' when x < 1000000 then '100000-1000000' else '>=1000000' end as bucket, count(*) as n
from a group by 1, 2""")
def scan_money_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = E.scan(table(spark, sf_dir, "documents"), only("money.iso_code"))
    amount = F.regexp_extract("value", "([0-9.]+)$", 1).cast("decimal(18,2)")
    return hits.groupBy("doc_id", T.money_bucket(amount, F.substring("value", 1, 3)).alias("bucket")).agg(F.count("*").alias("n"))


@query()
def scan_all_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over all documents, overlaps resolved; tests hold it against plain regular expressions."""
    return E.summarise(E.resolve(E.scan(table(spark, sf_dir, "documents"))))


@query("""with recursive s as (select l_orderkey as doc_id, l_linenumber as rule, (l_partkey * 31 % 17) as a, (l_partkey * 31 % 17) + 1 + l_suppkey % 7 as e, l_quantity::int % 5 as p from lineitem),
o as (select *, row_number() over (partition by doc_id order by p desc, e - a desc, a, rule) as r from s),
k(doc_id, r, kept) as (select doc_id, 0::bigint, []::struct(rule integer, a bigint, e bigint)[] from (select distinct doc_id from o) union all
select k.doc_id, o.r, case when len(list_filter(k.kept, lambda x: x.a < o.e and o.a < x.e)) > 0 then k.kept else list_append(k.kept, {'rule': o.rule, 'a': o.a, 'e': o.e}) end from k join o on o.doc_id = k.doc_id and o.r = k.r + 1)
select doc_id, u.rule as rule_id, u.a as "at" from (select doc_id, unnest(kept) as u from (select doc_id, arg_max(kept, r) as kept from k group by 1))""")
def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as spans of an order's text, many of them in chains."""
    at = F.col("l_partkey") * 31 % 17
    spans = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("rule_id"), at.alias("at"), (at + 1 + F.col("l_suppkey") % 7).alias("end"), (F.col("l_quantity").cast("int") % 5).alias("precedence")
    )
    return E.resolve(spans).select("doc_id", "rule_id", "at")


_XOR = "xor({0}, case when (a >> {1}) & 1 = 1 then {2}::bigint else 0::bigint end)"
_POLYMOD = "xor((a & 33554431) << 5, v)"
for _i, _g in enumerate(W.GENERATOR):
    _POLYMOD = _XOR.format(_POLYMOD, 25 + _i, _g)
_LONGS = "list_transform({0}, lambda x: x::bigint)"


@query(f"""with p as (select p_partkey, sha256(p_partkey::varchar) as h from part),
d as (select p_partkey, list_prepend(0::bigint, list_transform(range(32), lambda i: (('0x' || substr(h, (5 * (i // 4) + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)) as v from p),
r as (select p_partkey, v, xor(list_reduce(list_concat({_LONGS.format([1, *W.PREFIX])}, v, {_LONGS.format([0] * 6)}), lambda a, v: {_POLYMOD}), 1::bigint) as r from d),
t as (select p_partkey, 'bc1' || array_to_string(list_transform(list_concat(v, list_transform(range(6), lambda i: (r >> (25 - 5 * i)::int) & 31)), lambda x: substr('{W.BECH32}', (x + 1)::int, 1)), '') as a from r)
select p_partkey, case when p_partkey % 3 = 0 then a[:20] || case when a[21] = 'q' then 'p' else 'q' end || a[22:] else a end as address, p_partkey % 3 <> 0 as ok from t""")
def segwit_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitcoin addresses of hashes of parts' keys, one character of each third changed, and whether they are right."""
    # Rows are few bytes but much work: they are dealt to all cores, however few files or row groups hold them.
    keys = table(spark, sf_dir, "part").select("p_partkey").repartition(spark.sparkContext.defaultParallelism * 4, "p_partkey")
    made = keys.select("p_partkey", W.segwit_address(F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 40)).alias("a"))
    changed = F.concat(F.substring("a", 1, 20), F.when(F.substring("a", 21, 1) == "q", "p").otherwise("q"), F.substr("a", F.lit(22)))
    address = made.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, changed).otherwise(F.col("a")).alias("address"))
    return address.select("p_partkey", "address", W.bitcoin(F.col("address")).alias("ok"))
