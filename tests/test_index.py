"""The stored index: expressions against a scan of the texts, bounds, infixes, generations, plans."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docquarry.operators import postings as P
from docquarry.operators import search as S

WORDS = "the licence license apache alpha beta gamma delta e2 77 naive".split()


def texts():
    rng = random.Random(21)
    mark = lambda: rng.choice((" ", " ", " ", ", ", ". ", "! ", "?\n", " 3.14 ", ".x "))
    out = [(i, "".join(rng.choice(WORDS) + mark() for _ in range(rng.randrange(60)))) for i in range(700)]
    return [*out, (900, ""), (901, None), (902, "Apache LICENSE"), (903, "naïve Straße"), (904, "the " * 5000 + "end."), (902, "Apache"), (None, "apache license")]


DOCS = texts()
#: Of rows of one id the greatest text counts, none without an id.
KEPT = {d: t or "" for d, t in sorted(DOCS, key=lambda r: (r[0] or 0, r[1] or "")) if d is not None}
TOKENS = {d: re.findall("[a-z0-9]+", t.lower()) for d, t in KEPT.items()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    out = P.Index(spark, str(tmp_path_factory.mktemp("index")))
    rows = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert out.add(rows.where("doc_id < 300")) == 300
    assert out.add(rows) == len(KEPT) - 300 and out.add(rows) == 0
    return out


def holds(node, doc):
    toks = TOKENS[doc]
    at = lambda w: [i for i, t in enumerate(toks) if t == w]
    if isinstance(node, P.Term):
        return node.words[0] in toks
    if isinstance(node, P.Wild):
        return any(re.fullmatch(node.patterns[0].replace("*", ".*"), t) for t in toks)
    if isinstance(node, P.Start):
        return toks[:1] == [node.words[0]]
    if isinstance(node, P.Phrase):
        return any(toks[i : i + len(node.words)] == list(node.words) for i in range(len(toks)))
    if isinstance(node, P.Near):
        return any(abs(i - j) <= node.within for i in at(node.words[0]) for j in at(node.words[1]))
    if isinstance(node, P.Sentence):
        return any(set(node.words) <= set(re.findall("[a-z0-9]+", s)) for s in re.split(r"[.!?]+(?:[ \t\r\n]|\Z)", KEPT[doc].lower()))
    inner = [holds(n, doc) for n in node.nodes]
    return {P.All: all(inner), P.Any: any(inner), P.Not: not inner[0], P.Maybe: inner[0], P.Boost: inner[0]}.get(type(node), sum(inner) >= getattr(node, "least", 0))


def gain(leaf, doc):
    test = (lambda t: re.fullmatch(leaf.replace("*", ".*"), t)) if "*" in leaf else (lambda t: t == leaf)
    tf = sum(bool(test(t)) for t in TOKENS[doc])
    df = sum(any(test(t) for t in toks) for toks in TOKENS.values())
    mean = sum(map(len, TOKENS.values())) / len(TOKENS)
    return math.log(1 + (len(TOKENS) - df + 0.5) / (df + 0.5)) * tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * len(TOKENS[doc]) / mean)) if tf else 0.0


def score(node, doc):
    if isinstance(node, P.Not) or not holds(node, doc):
        return 0.0
    if isinstance(node, P.Leaf):
        return sum(gain(leaf, doc) for leaf in dict.fromkeys(node.leaves))
    return sum(score(n, doc) for n in node.nodes) * getattr(node, "weight", 1.0)


T = P.Term
NODES = [
    T("apache"), T("License"), T("absent") | T("alpha"), T("apache") & ~T("license"), (T("alpha") | T("beta")) & (T("gamma") | ~T("the")), P.Phrase("apache", "license"), P.Phrase("the", "the", "the"), P.Phrase("alpha"),
    P.Near("apache", "beta", 3), P.Near("the", "the", 1), P.Sentence("apache", "license"), P.Sentence("the", "77"), P.Maybe(T("apache"), P.Phrase("apache", "license")), P.Boost(T("e2"), 2.5) | T("77"),
    P.Quorum(2, T("apache"), P.Phrase("alpha", "beta"), ~T("the")), P.Start("the"), P.Wild("lic*"), P.Wild("*icen*e"), P.Wild("*a*") & T("e2") & ~P.Near("alpha", "beta", 2), P.Wild("na*") | P.Wild("stra*"),
]


@pytest.mark.parametrize("at", range(len(NODES)))
def test_expressions(index, at):
    node = NODES[at]
    got = {r["doc_id"]: round(r["score"], 6) for r in P.search(index, node).collect()}
    assert got == {d: round(score(node, d), 6) for d in KEPT if holds(node, d)}


@pytest.mark.parametrize("node", [~T("the"), ~T("the") | T("apache"), P.Quorum(1, T("apache"), ~T("the")), P.Maybe(~T("the"), T("apache"))])
def test_all_negation_is_refused(index, node):
    with pytest.raises(ValueError):
        P.search(index, node)


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("weights", [{"apache": 1.0}, {"apache": 1.0, "license": 2.0}, {"the": 1.0, "absent": 1.0}])
def test_top(index, weights, every):
    docs = [d for d in KEPT if (all if every else any)(w in TOKENS[d] for w in weights)]
    want = sorted(((-round(sum(k * gain(w, d) for w, k in weights.items()), 9), d) for d in docs))[:7]
    assert [(-round(r["score"], 9), r["doc_id"]) for r in P.top(index, weights, 7, every).collect()] == want


def test_top_reads_few_groups(spark, tmp_path):
    """A word that a few groups hold often: the bounds of all others lie below the k-th score."""
    rows = [(i, "rare " * (9 if i % 400 == 0 else 1) + "filler " * (20 if i % 400 else 0)) for i in range(4000)]
    index = P.Index(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in P.top(index, {"rare": 1.0}, 10).collect()} == {i for i in range(0, 4000, 400)}


def test_only_the_buckets_of_the_words_are_read(index):
    plan = index.blocks(["apache"]).select("term", "n")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(bucket" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "ReadSchema: struct<term:string,n:int>" in plan and "apache" in plan.split("PushedFilters: ")[1]


@pytest.mark.parametrize("pattern", ["*icen*", "lic*", "*a", "a*", "*", "th*e", "e2", "*77*", "x_%", "*a*a*", ""])
def test_infixes(index, pattern):
    words = {t for toks in TOKENS.values() for t in toks}
    assert {r["term"] for r in index.like(pattern).collect()} == {w for w in words if re.fullmatch(re.escape(pattern).replace(r"\*", ".*"), w)}


def test_dictionary_and_statistics(index):
    got = {r["term"]: (r["df"], r["cf"]) for r in index.dictionary().collect()}
    assert got == {w: (sum(w in t for t in TOKENS.values()), sum(t.count(w) for t in TOKENS.values())) for w in {t for toks in TOKENS.values() for t in toks}}
    n, mean = index.statistics()
    assert n == len(KEPT) and abs(mean - sum(map(len, TOKENS.values())) / len(KEPT)) < 1e-9


def test_a_generation_that_was_not_finished_does_not_count(spark, index, tmp_path):
    import shutil

    shutil.copytree(index.path, tmp_path / "copy")
    (tmp_path / "copy/docs/gen=1/_SUCCESS").unlink()
    other = P.Index(spark, str(tmp_path / "copy"))
    assert other.statistics()[0] == 300 and other.generations() == [0]
    assert other.add(spark.createDataFrame(DOCS, "doc_id long, text string")) == len(KEPT) - 300
    assert other.statistics()[0] == len(KEPT)


def test_parts_of_a_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "PART_WORDS", 50)
    index = P.Index(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame(DOCS, "doc_id long, text string"))
    got = {r["term"]: (r["df"], r["cf"]) for r in index.dictionary().collect()}
    assert got["apache"] == (sum("apache" in t for t in TOKENS.values()), sum(t.count("apache") for t in TOKENS.values()))
    assert {r["doc_id"] for r in P.search(index, NODES[8]).collect()} == {d for d in KEPT if holds(NODES[8], d)}


def test_an_index_of_nothing(spark, tmp_path):
    index = P.Index(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        index.table("docs")
    index.add(spark.createDataFrame([(1, None)], "doc_id long, text string"))
    assert index.statistics()[0] == 1
    assert P.search(index, T("apache")).count() == P.top(index, {"apache": 1.0}, 5).count() == index.like("*a*").count() == 0
    none = P.Index(spark, str(tmp_path / "none"))
    none.add(spark.createDataFrame([], "doc_id long, text string"))
    assert none.statistics() == (0, 1.0) and P.search(none, T("apache")).count() == 0


def test_inverter_holds_words_as_numbers():
    """Words of a group take few bytes each while they are held: in the test before the blocks are made, as Python's strings some 45."""
    import tracemalloc

    import pyarrow as pa

    from docquarry.operators import postings

    def batches(peaks):
        for b in range(8):
            yield pa.record_batch([pa.array([0] * 64), pa.array(range(64 * b, 64 * b + 64)), pa.array([" ".join(f"w{(i * 7 + d) % 900}" for i in range(200)) for d in range(64)])], ["grp", "doc_id", "text"])
            peaks.append(tracemalloc.get_traced_memory()[0])

    list(postings._inverter(batches([])))  # what is loaded at first use doesn't count
    tracemalloc.start()
    try:
        before, peaks = tracemalloc.get_traced_memory()[0], []
        rows = sum(b.num_rows for b in postings._inverter(batches(peaks)))
    finally:
        tracemalloc.stop()
    assert rows == 901 and (peaks[-1] - before) / (8 * 64 * 200) < 20


def test_terms_are_dealt_before_their_grams(spark, tmp_path):
    """All grams of a term are written by one task: what is shuffled is terms."""
    from docquarry.operators import postings

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = postings.Index(spark, str(tmp_path / "grams"))
        index.add(spark.createDataFrame([(d, " ".join(f"word{i * d % 97}s" for i in range(40))) for d in range(60)], "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    grams = index.table("grams").withColumn("task", F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1))
    assert {r["n"] for r in grams.groupBy("term").agg(F.count_distinct("task").alias("n")).collect()} == {1}
    terms = {r["term"] for r in index.dictionary().collect()}
    expected = {(f"^{t}$"[i : i + 3], t) for t in terms for i in range(len(t))}
    assert sorted((r["gram"], r["term"]) for r in grams.collect()) == sorted(expected) and len(terms) > 50
