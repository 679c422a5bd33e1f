"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import codebooks, decontaminate, spelling
from docquarry.llm.ann import op8_nearest
from docquarry.llm.codebooks import op12_codebooks
from docquarry.llm.decontaminate import op13_decontaminate
from docquarry.llm.fingerprints import op4_fingerprints
from docquarry.llm.licenses import GAP, LOWER, UPPER, op1_licenses
from docquarry.llm.mixing import op9_mixing
from docquarry.llm.passages import op3_passages
from docquarry.llm.sentencepiece import op10_sentencepiece
from docquarry.llm.sharding import op5_sharding
from docquarry.llm.simhash import op6_simhash
from docquarry.llm.spelling import op11_spelling
from docquarry.llm.suffixes import op7_repeats
from docquarry.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_toxicity": op2_toxicity,
    "op3_passages": op3_passages,
    "op4_fingerprints": op4_fingerprints,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_repeats": op7_repeats,
    "op8_nearest": op8_nearest,
    "op9_mixing": op9_mixing,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_spelling": op11_spelling,
    "op12_codebooks": op12_codebooks,
    "op13_decontaminate": op13_decontaminate,
}


#: What SQL can express of two operators, as queries of their own.
_phrase = lambda a: f"list_filter(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + {len(a.split()) - 1}], ' ') = '{a}')"
BASE_SQL = f"""with t as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '') as w from documents),
p as (select doc_id, len(w) as n, {_phrase("apache license")} as a, {_phrase("general public license")} as g, {_phrase("mit license")} as m from t),
s as (select *, list_concat(list_concat(a, g), m) as places from p)
select doc_id, n::bigint as n_words, len(places)::bigint as n_base, (list_min(places) - 1)::bigint as first_word, (list_max(places) - 1)::bigint as last_word,
  array_to_string(list_filter([case when len(a) > 0 then 'apache' end, case when len(g) > 0 then 'gpl' end, case when len(m) > 0 then 'mit' end], lambda x: x is not null), ',') as base_labels from s"""
SHARDS_SQL = """with d as (select doc_id, strlen(coalesce(text, '')) + 1 as size from documents),
b as (select doc_id, size, coalesce(sum(size) over (order by doc_id nulls first rows between unbounded preceding and 1 preceding), 0) as before, sum(size) over () as total from d),
s as (select doc_id, size, least(15, (16 * (before * 2 + size)) // (2 * total))::int as shard from b)
select doc_id, size::bigint as size, 'bytes' as law, shard, (row_number() over (partition by shard order by doc_id nulls first) - 1)::bigint as slot from s"""


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base findings of op1_licenses."""
    return op1_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def shards_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_sharding without the check sum, which SQL lacks."""
    return op5_sharding(spark, sf_dir).select("doc_id", "size", "law", "shard", "slot")


QUERIES |= {"licenses_base": licenses_base, "shards_by_bytes": shards_by_bytes}
ORACLES: dict[str, str | None] = {"licenses_base": BASE_SQL, "shards_by_bytes": SHARDS_SQL, "op11_spelling": spelling.SQL, "op12_codebooks": codebooks.SQL, "op13_decontaminate": decontaminate.SQL}
