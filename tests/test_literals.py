"""Rules on examples written down with their answers."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from docquarry.functions import checksums as C
from docquarry.functions import entities as N
from docquarry.functions import text as T
from docquarry.functions import types
from docquarry.operators import graph as G
from docquarry.operators import tables as tab


def answers(spark, rule, asked):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, a string")
    return [r[1] for r in df.select("i", rule(F.col("a"))).orderBy("i").collect()]


@pytest.mark.parametrize("rule,good,bad", [
    (C.iban, ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"], ["GB82 WEST 1234 5698 7654 33"]), (C.mod_97, ["5493001KJTIIGC8Y1R12"], ["5493001KJTIIGC8Y1R13"]),
    (C.isin, ["US0378331005"], ["US0378331006"]), (C.imo, ["9074729"], ["9074728"]), (C.mod_11_2, ["0000-0002-1825-0097"], ["0000-0002-1825-0098"]),
    (C.luhn, ["4111 1111 1111 1111"], ["4111 1111 1111 1112"]), (C.damm, ["5724"], ["5725"]), (C.mod_11_10, ["07945"], ["07946"]),
])
def test_check_digits(spark, rule, good, bad):
    assert answers(spark, rule, good) == [True] * len(good) and answers(spark, rule, bad) == [False] * len(bad)


def test_kinds_of_media_types(spark):
    want = {
        "text/plain": "text", "text/csv": "table", "application/pdf": "pdf", "image/png": "image", "message/rfc822": "email", "application/zip": "archive", "video/mp4": "video", "audio/mpeg": "audio",
        "application/vnd.ms-excel": "table", "text/html": "html", "application/x-unknown": "other",
    }
    assert answers(spark, types.coarse_type, list(want)) == list(want.values())


def test_canonical_types(spark):
    cases = [
        (["application/pdf", "text/plain"], 0, "pdf", "content"), (["application/zip"], 3, "archive", "members"), (["application/zip"], 0, "other", "none"),
        (["application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip"], 5, "office", "zip document"), (["text/plain", "message/rfc822"], 0, "email", "content"), ([], 0, "other", "none"),
        (["text/plain", "text/csv"], 0, "table", "content"),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, m array<string>, n int")
    got = df.select("i", types.canonical_type(F.col("m"), F.col("n")).alias("t")).select("i", "t.*").orderBy("i").collect()
    assert [(r["kind"], r["decided_by"]) for r in got] == [c[2:] for c in cases]


def test_sniffed_tables(spark):
    bodies = ["a,b,c\n1,2,3\n4,5,6\n7,8,9\n0,0,0", "a;b\n1;2\n3;4\n5;6\n7;8", "just words\nand, more\nlines here\nof prose\nend", "x\ty\tz\n1\t2\t3\n1\t2\t3\n1\t2\t3\n1\t2\t3", "a,b\n1,2"]
    assert [t and (t["sep"], t["fields"], t["lines"]) for t in answers(spark, types.sniff_table, bodies)] == [(",", 3, 5), (";", 2, 5), None, ("\t", 3, 5), None]


def test_cells(spark):
    want = {
        "1": "int", "007": "text", "-5": "int", "3.14": "float", "1e5": "text", "2024-02-29": "date", "2023-02-29": "text", "2024-01-01 10:00": "date", "true": "text", "9223372036854775807": "int",
        "9223372036854775808": "text", "0": "int", "-0.5": "float", "abc": "text", ".5": "text",
    }
    assert answers(spark, tab.cell_kind, list(want)) == list(want.values())


def test_column_letters_and_serials(spark):
    want = {1: "A", 26: "Z", 27: "AA", 52: "AZ", 53: "BA", 299: "KM", 702: "ZZ", 703: "AAA", 16384: "XFD", 18278: "ZZZ", 18279: "AAAA"}
    assert answers(spark, lambda c: tab.column_letter(c.cast("int")), [str(i) for i in want]) == list(want.values())
    days = {1: "1900-01-01", 59: "1900-02-28", 61: "1900-03-01", 367: "1901-01-01", 44197: "2021-01-01", 45000: "2023-03-15"}
    got = answers(spark, lambda c: tab.excel_serial(c.cast("int")).cast("timestamp_ntz"), [str(i) for i in days])
    assert got == [datetime.datetime.fromisoformat(d) for d in days.values()]


def test_subjects(spark):
    want = {
        "Re: Fwd:  Budget   2024": ("budget 2024", "reply"), "AW: Re[2]: Hello": ("hello", "reply"), "no prefix": ("no prefix", "none"), "  RE :  spaced": ("spaced", "reply"), "Fw: Re: x": ("x", "forward"),
        "Regarding: y": ("regarding: y", "none"), "": ("", "none"),
    }
    assert list(zip(answers(spark, T.normalise_subject, list(want)), answers(spark, T.subject_prefix_kind, list(want)), strict=True)) == list(want.values())


def test_noise_entities_and_date_formats(spark):
    stopped = {"John Smith": False, "re": True, "12345": True, "ACME Ltd": False, "x": True, "aGVsbG8gd29ybGQgYmFzZTY0": True, "From: Jane": True, "----": True, "": True}
    assert answers(spark, types.is_stopped_entity, list(stopped)) == list(stopped.values())
    formats = {
        "General": False, "0.00": False, "yyyy-mm-dd": True, "m/d/yy h:mm": True, '"days" 0': False, "[h]:mm:ss": True, "0.00E+00": False, '#,##0 "hrs"': False, "[Red]0": False, "\\d0": False, "mmm-yy": True, "@": False, "_d0": False,
    }
    assert answers(spark, N.is_date_format, list(formats)) == list(formats.values())


def test_mail_edges(spark):
    """Equal message ids, references, and subjects that follow on one another."""
    mail = [
        (1, "<a@x>", "", "Budget plan", 1000, "ann,bob"), (2, "<b@x>", "<a@x>", "Re: Budget plan", 2000, "bob,ann"), (3, "<a@x>", "", "Budget plan", 1000, "ann,bob"), (4, "<d@x>", "<zz@x> <b@x>", "AW: Budget plan", 3000, "cyd"),
        (5, "<e@x>", "", "Other", 500, "eve"), (6, "<f@x>", "", "Re: Other", 900, "eve,ann"), (7, "<g@x>", "", "Hi", 100, "ann"), (8, "<h@x>", "", "Re: Hi", 200, "ann"),
    ]
    rows = spark.createDataFrame(mail, "id long, message string, refs string, subject string, at long, people string")
    nodes = rows.select(
        "id", T.normalise_message_id(F.col("message")).alias("message"), T.split_message_ids(F.col("refs")).alias("refs"), T.normalise_subject(F.col("subject")).alias("subject"),
        (T.subject_prefix_kind(F.col("subject")) != "none").alias("marked"), "at", F.split("people", ",").alias("people"),
    )
    same, named = G.star_edges(nodes, "id", ["message"], "identity"), G.parent_edges(nodes, "id", "message", F.col("refs"), "reply")
    follows = G.follow_edges(nodes, "id", "subject", "at", "people", "marked", 90 * 86400)
    got = {tuple(r) for r in same.unionByName(named).unionByName(follows).collect()}
    assert got == {(3, 1, "identity"), (2, 1, "reply"), (2, 3, "reply"), (4, 2, "reply"), (2, 1, "inferred"), (2, 3, "inferred"), (6, 5, "inferred")}
    assert {(r["kind"], r["edges"], r["nodes"]) for r in G.edge_counts(spark.createDataFrame(list(got), "src long, dst long, kind string")).collect()} == {("identity", 1, 1), ("reply", 3, 2), ("inferred", 3, 2)}


def test_a_cycle_of_containers(spark):
    got = {tuple(r) for r in G.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 2), (4, 5), (5, 6)], "node long, parent long")).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (2, 1, 2), (3, 1, 1), (3, 2, 2), (4, 2, 1), (4, 5, 1), (4, 3, 2), (4, 6, 2), (4, 1, 3), (5, 6, 1)}
