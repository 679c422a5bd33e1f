"""Rules against plain Python: entities of all kinds, a limiter, user queries, edge cases of money and columns."""

from __future__ import annotations

import collections
import re

import pandas as pd
from pyspark.sql import functions as F

from docquarry import sqlfunctions
from docquarry.functions import entities as N
from docquarry.operators import entities as E
from docquarry.operators import packing, tables
from docquarry.plans import registry

SF = "/root/testdata/sf0.001"
NOTES = [
    (1, "Pay to GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33 by 2024-02-29, not 2023-02-29."), (2, "LEI 5493001KJTIIGC8Y1R12, ISIN US0378331005, vessel IMO 9074729 and IMO 9074728."),
    (3, "See CVE-2021-44228, doi 10.1000/182 and 0000-0002-1825-0097 from 00:1A:2B:3C:4D:5E."), (4, "Paid USD 1,234.50 and EUR 20 on 2024-01-02, mail Jane.Doe@Example.ORG."), (5, "nothing here"),
    (6, "box CSQU3054383 or CSQU3054384, at 52.5200, 13.4050 or 95.0000, 13.4050; AS13335, AS0; 219-09-9999, 666-09-9999; +49 30 901820"),
]


def test_rules_on_public_examples(spark):
    found = E.summarise(E.resolve(E.scan(spark.createDataFrame(NOTES, "doc_id long, text string")))).collect()
    got = {(r["kind"], r["value"]) for r in found}
    assert got == {
        ("bank_account", "GB82WEST12345698765432"), ("company_id", "5493001KJTIIGC8Y1R12"), ("security", "US0378331005"), ("vessel", "IMO 9074729"), ("vulnerability", "CVE-2021-44228"),
        ("publication", "10.1000/182"), ("publication", "0000-0002-1825-0097"), ("device", "00:1a:2b:3c:4d:5e"), ("money", "USD1234.50"), ("money", "EUR20"), ("email", "Jane.Doe@example.org"),
        ("date", "2024-02-29"), ("date", "2024-01-02"), ("cargo_container", "CSQU3054383"), ("coordinates", "52.5200, 13.4050"), ("network", "AS13335"), ("national_id", "219-09-9999"), ("phone", "+4930901820"),
    }


def test_scan_all_by_plain_matching(spark):
    """Every value that the summary names is matched by a rule of its kind in as many documents at least."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    hits = E.scan(spark.createDataFrame(docs[["doc_id", "text"]])).toPandas()
    texts = dict(zip(docs.doc_id, docs.text))
    pattern = {r.rule_id: re.compile(r.pattern) for r in E.RULES}
    assert all(texts[h.doc_id][h.at - 1 : h.end - 1] == h.matched and pattern[h.rule_id].fullmatch(h.matched) for h in hits.itertuples())
    best = collections.defaultdict(list)
    for h in sorted(hits.itertuples(), key=lambda h: (-h.precedence, h.at - h.end, h.at, h.rule_id)):
        if all(h.at >= k.end or k.at >= h.end for k in best[h.doc_id]):
            best[h.doc_id].append(h)
    want = collections.Counter((h.kind, h.value) for own in best.values() for h in own)
    assert {(r["kind"], r["value"]): r["n"] for r in registry.QUERIES["scan_all_summary"](spark, SF).collect()} == want


def test_a_chain_of_overlaps_keeps_what_only_a_loser_met(spark):
    spans = [(1, "a", 1, 6, 90), (1, "b", 4, 10, 80), (1, "c", 8, 12, 50), (2, "a", 1, 4, 50), (2, "b", 2, 4, 50)]
    got = E.resolve(spark.createDataFrame(spans, "doc_id long, rule_id string, at int, end int, precedence int")).collect()
    assert sorted((r["doc_id"], r["rule_id"]) for r in got) == [(1, "a"), (1, "c"), (2, "a")]
    assert E.resolve(spark.createDataFrame([], "doc_id long, rule_id string, at int, end int, precedence int")).count() == 0


def test_units_never_exceed_a_limit(spark):
    rows = [(g, i, n) for g, sizes in (("a", [50, 60, 30, 200, 10, 10]), (None, [1] * 7), ("b", [None, 100])) for i, n in enumerate(sizes)]
    got = packing.pack(spark.createDataFrame(rows, "g string, i int, n long"), "g", ["i"], F.col("n"), 100, 3).collect()
    units = {(r["g"], r["i"]): r["unit"] for r in got}
    assert [units["a", i] for i in range(6)] == [0, 1, 1, 2, 3, 3] and [units[None, i] for i in range(7)] == [0, 0, 0, 1, 1, 1, 2] and [units["b", i] for i in range(2)] == [0, 0]


def test_limiter_by_a_loop(spark):
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values("ts")
    want = {}
    for user, own in events.groupby("user_id"):
        passed, allowed = [], 0
        for t in (own.ts.astype("datetime64[us]").astype("int64") // 1_000_000).tolist():
            passed = [p for p in passed if p > t - 86400]
            if len(passed) < 5:
                passed.append(t)
                allowed += 1
        want[user] = (allowed, len(own) - allowed)
    got = registry.QUERIES["stream_stateful_limiter"](spark, SF).collect()
    assert {r["user_id"]: (r["allowed"], r["refused"]) for r in got} == want


def test_user_queries_are_made_safe(spark):
    cases = {"3/4": "3 4", 'say"hi': "sayhi", "a~2": "a 2", "(a | b": "(a | b)", "computer": "computer", "   ": "", '"a b"~5 c)': '"a b"~5 c', '"a (b" c': '"a (b" c', "!a": "!a", '"a b c"/2': '"a b c"/2'}
    rows = spark.createDataFrame([(q,) for q in cases], "q string").select("q", N.prepared_match(F.col("q")).alias("m")).select("*", N.has_positive_term(F.col("m")).alias("ok")).collect()
    assert {r["q"]: r["m"] for r in rows} == cases and {r["q"] for r in rows if not r["ok"]} == {"!a"}


def test_money_columns_and_functions(spark):
    rows = spark.createDataFrame([("1,234.5", 2), ("-0.05", 2), ("7", 0), ("1.234", 2), ("0012", 3)], "a string, p int")
    assert [r[0] for r in rows.select(N.minor_units(F.col("a"), F.col("p"))).collect()] == ["123450", "-5", "7", None, "12000"]
    letters = spark.createDataFrame([(i,) for i in (1, 26, 27, 702, 703, 16384)], "i long").select(tables.column_letter(F.col("i"))).collect()
    assert [r[0] for r in letters] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert {"dq_slug", "dq_lines", "dq_hash63"} <= set(sqlfunctions.register(spark))
    assert spark.sql("select dq_slug('A b!'), dq_size_bucket(5), dq_hash63('x') >= 0").first()[:] == ("a_b", "small", True)
    assert [r["line"] for r in spark.sql("select line from dq_lines('a\nb') order by line_number").collect()] == ["a", "b"]


def test_what_a_search_may_ask(spark):
    import pytest

    from docquarry.operators import search as S

    assert S.queryable("file_types") == "file_types" and S.assert_readable("a_b", ["a_b"]) == "a_b"
    for bad, kind in ((lambda: S.queryable("evil"), ValueError), (lambda: S.within(2, 1, F.col("x")), ValueError), (lambda: S.assert_readable("a_b", []), PermissionError)):
        with pytest.raises(kind):
            bad()
    assert S.collections_of([], ["a", "b"]) == ["a", "b"] and S.collections_of(["a_x"], ["a", "b"]) == ["a"]
    rows = spark.createDataFrame([(1, 5, 0.1), (2, 9, 0.9), (3, None, 0.5)], "id int, x int, s double")
    assert [r["id"] for r in rows.where(S.within(None, 5, F.col("x"))).collect()] == [1] and rows.where(S.within(None, None, F.col("x"))).count() == 3
    by = lambda asked: [r["id"] for r in rows.orderBy(*S.order_of("relevance", asked, F.col("x"), F.col("s"), ["id"])).collect()]
    assert by(" ") == [2, 1, 3] and by("word") == [2, 3, 1]
    text = "The other theme: THE end, lathe"
    spans = spark.createDataFrame([(text,), ("",)], "t string").select(S.highlight_spans(F.col("t"), ["the", "heme", "end", "er"]).alias("s")).collect()
    marked = [any(text.lower()[i - k : i - k + len(t)] == t and i - k >= 0 for t in ("the", "heme", "end", "er") for k in range(len(t))) for i in range(len(text))]
    assert [tuple(x) for x in spans[1]["s"]] == []
    got = [any(a <= i + 1 < b for a, b in spans[0]["s"]) for i in range(len(text))]
    assert got == marked and all(b < c for (_, b), (c, _) in zip(spans[0]["s"], spans[0]["s"][1:]))


def test_quotes_of_any_number_of_words_read_texts_twice(spark):
    """Quotes of one to nine words against plain containment; a text is taken apart for those of one word and once for all others."""
    import random

    from docquarry.plans.processing import quoted

    rng = random.Random(4)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice((1, 3, 7, 14)))) for _ in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(25)]
    quotes = [t[at : at + n].strip() for t in texts for n in (13, 20, 45, 90) for at in (rng.randrange(200),)] + ["a" * 15, "b a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")
    found = quoted(spark.createDataFrame(list(enumerate(quotes)), "item_id long, quote string"), docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("posexplode") <= 2
    assert {tuple(r) for r in found.collect()} == {(i, d) for i, q in enumerate(quotes) if len(q) >= 12 for d, t in enumerate(texts) if q in t}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("explode(") <= 4
