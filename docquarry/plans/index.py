"""Searches over the stored index: expressions, ranking, infixes, generations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.catalog import table
from docquarry.operators import postings as P
from docquarry.plans.registry import query
from docquarry.plans.search import BM25, TOK
from docquarry.session import shared_dir

#: Folders of indexes by application and tables: the queries of a session share one.
_BUILT: dict[tuple[str, str], str] = {}


def index_of(spark: SparkSession, sf_dir: str) -> P.Index:
    """The index of the documents of a folder, built when first asked for in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    index = P.Index(spark, _BUILT.get(key) or f"{shared_dir(spark)}/docquarry/index-{uuid.uuid4().hex}")
    if not index.generations():
        index.add(table(spark, sf_dir, "documents"))
    _BUILT[key] = index.path
    return index


@query(BM25.replace("select doc_id, source, round(", "select doc_id, round("))
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents with both words, by bounds of blocks."""
    found = P.top(index_of(spark, sf_dir), {"apache": 1.0, "license": 1.0}, 20, every=True)
    return found.select("doc_id", F.round("score", 6).alias("score"))


T = P.Term
EXPRESSIONS = {
    "negation": T("license") & ~T("apache"),
    "grouping": (T("apache") | T("idiot")) & T("the"),
    "phrase": P.Phrase("apache", "license"),
    "near": P.Near("the", "license", 6),
    "sentence": P.Sentence("license", "apache"),
    "maybe": P.Maybe(T("license"), T("apache")),
    "boost": P.Boost(T("apache"), 3.0) | T("license"),
    "quorum": P.Quorum(2, T("license"), T("apache"), T("idiot")),
    "start": P.Start("the"),
    "wildcard": P.Wild("*icens*") & ~P.Phrase("apache", "license"),
}
_LEAVES = {"license": "x = 'license'", "apache": "x = 'apache'", "the": "x = 'the'", "idiot": "x = 'idiot'", "wild": "x like '%icens%'"}
_TESTS = {
    "negation": ("tf_license > 0 and tf_apache = 0", "b_license"),
    "grouping": ("(tf_apache > 0 or tf_idiot > 0) and tf_the > 0", "b_apache + b_idiot + b_the"),
    "phrase": ("phrase", "b_apache + b_license"),
    "near": ("len(list_filter(p_the, i -> len(list_filter(p_license, j -> abs(i - j) <= 6)) > 0)) > 0", "b_the + b_license"),
    "sentence": (f"len(list_filter(string_split_regex(lower(text), '[.!?]+([ \\t\\r\\n]|$)'), s -> list_has_all({TOK.replace('lower(text)', 's')}, ['license', 'apache']))) > 0", "b_license + b_apache"),
    "maybe": ("tf_license > 0", "b_license + b_apache"),
    "boost": ("tf_license > 0 or tf_apache > 0", "3 * b_apache + b_license"),
    "quorum": ("(tf_license > 0)::int + (tf_apache > 0)::int + (tf_idiot > 0)::int >= 2", "b_license + b_apache + b_idiot"),
    "start": ("toks[1] = 'the'", "b_the"),
    "wildcard": ("tf_wild > 0 and not phrase", "b_wild"),
}
_B = "ln(1 + (n - df_{0} + 0.5) / (df_{0} + 0.5)) * tf_{0} * 2.2 / (tf_{0} + 1.2 * (0.25 + 0.75 * dl / av)) as b_{0}"
_PLACES = ", ".join(f"list_filter(range(1, len(toks) + 1), lambda i: toks[i] = '{w}') as p_{w}" for w in ("the", "license", "apache"))
EXPRESSIONS_SQL = f"""with t as (select doc_id, text, {TOK} as toks from documents),
d as (select *, len(toks) as dl, {", ".join(f"len(list_filter(toks, lambda x: {test})) as tf_{w}" for w, test in _LEAVES.items())}, {_PLACES} from t),
s as (select count(*)::double as n, avg(dl) as av, {", ".join(f"count(*) filter (tf_{w} > 0) as df_{w}" for w in _LEAVES)} from d),
f as (select *, len(list_filter(p_apache, lambda i: toks[i + 1] = 'license')) > 0 as phrase, {", ".join(_B.format(w) for w in _LEAVES)} from d, s)
""" + " union all ".join(f"select '{name}' as asked, doc_id, round({score}, 6) as score from f where {test}" for name, (test, score) in _TESTS.items())
EXPRESSIONS_SQL = EXPRESSIONS_SQL.replace("i -> ", "lambda i: ").replace("j -> ", "lambda j: ").replace("s -> ", "lambda s: ")


@query(EXPRESSIONS_SQL)
def index_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negation, grouping, phrase, nearness, sentence, optional and weighted parts, quorum, start and wildcard over postings."""
    index, out = index_of(spark, sf_dir), None
    for name, node in EXPRESSIONS.items():
        found = P.search(index, node).select(F.lit(name).alias("asked"), "doc_id", F.round("score", 6).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


PATTERNS = ("*icens*", "li*", "*ing", "a*", "te*t")


@query(f"""with t as (select doc_id, unnest({TOK}) as term from documents), v as (select term, count(distinct doc_id) as df from t group by 1)
{" union all ".join(f"select '{p}' as pattern, term, df from v where term like '{p.replace('*', '%')}'" for p in PATTERNS)}""")
def index_infix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of patterns by their character n-grams, with how many documents have them."""
    index, out = index_of(spark, sf_dir), None
    for p in PATTERNS:
        found = index.like(p).select(F.lit(p).alias("pattern"), "term")
        out = found if out is None else out.unionByName(found)
    return out.join(index.dictionary().select("term", "df"), "term").select("pattern", "term", "df")


@query(f"""with t as (select doc_id, unnest({TOK}) as term from documents) select term, count(distinct doc_id) as df, count(*) as cf from t group by 1""")
def index_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of an index that got the English documents first and then, of all, those that it lacked."""
    index = P.Index(spark, f"{shared_dir(spark)}/docquarry/index-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    index.add(docs.where("lang = 'en'"))
    index.add(docs)
    return index.dictionary()
