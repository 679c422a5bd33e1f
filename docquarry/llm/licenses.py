"""License scan by diagonal voting of word k-grams."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import table

#: Not part of a word, after A-Z are lower-cased.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """Words to look for. k: words of a gram. least: matched share of the words that makes a finding."""

    label: str
    text: str
    k: int
    least: float
    base: bool = False

    def words(self) -> list[str]:
        return [w for w in re.split(GAP, self.text.lower()) if w]


#: The base phrases, then wording from the public licence notices.
TEMPLATES = (
    Template("mit", "mit license", 2, 1.0, True),
    Template("apache", "apache license", 2, 1.0, True),
    Template("gpl", "general public license", 2, 1.0, True),
    Template("apache-2.0", "licensed under the apache license version 2.0", 3, 0.8),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", 3, 0.8),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4.0", 3, 0.8),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 3, 0.7),
    Template("apache-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at", 3, 0.7),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 3, 0.7),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 3, 0.7),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", 3, 0.8),
    Template("warranty", "the software is provided as is without warranty of any kind express or implied", 3, 0.7),
)


def words_of(text: Column) -> Column:
    """Lower-cased words; only A-Z change case, so that a character beyond ASCII never becomes a-z."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(text.rlike("[\\u0130\\u212A]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(plain, GAP), "")


def rolling(sizes: Sequence[int]) -> Column:
    """(words, 1, 2, ...): each word of the column padded and those after it, as many as the longest
    gram has. Grams that run over the end are hashed without the missing words and fail the
    comparison of words."""
    return F.arrays_zip("padded", *[F.slice("padded", F.lit(j + 1), F.size("padded")) for j in range(1, max(sizes))])


def scan(spark: SparkSession, docs: DataFrame, templates: Sequence[Template] = TEMPLATES, drift: int = 2) -> DataFrame:
    """Find where documents hold the words of the templates, word for word or with a few changed.

    All rolling k-gram hashes of a document, for each k in use, are joined with the templates' gram
    positions (broadcast: the templates are a parameter). A match votes for the diagonal (word
    position less template position); diagonals of one template that lie within `drift` of each
    other at neighbouring places are merged, so that a word more or less does not part a finding.
    Spans are verified: grams are compared word for word, and a base phrase must be whole, of any
    other the share of its template's words that are matched must be its `least` or more.

    Null and empty texts have no words, null doc_ids and repeated rows are kept as they come, ties
    cannot arise, other columns are ignored, an empty table gives an empty result.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the
    greatest matched share of a finding, 0 without one), spans (findings as
    "label:first-last", by place).
    """
    grams = [
        (i, at, t.k, len(words), t.base, t.least, t.label, " ".join(words[at : at + t.k]))
        for i, t in enumerate(templates)
        for words in (t.words(),)
        for at in range(len(words) - t.k + 1)
    ]
    known = spark.createDataFrame(
        [*grams, (-1, 0, 0, 0, False, 0.0, "", "")],
        "template int, at int, k int, length int, base boolean, least double, label string, gram string",
    )
    parts = F.split("gram", " ")
    sizes = sorted({t.k for t in templates})
    hashed = F.lit(0).cast("long")
    for k in sizes:
        hashed = F.when(F.col("k") == k, F.xxhash64(*[F.get(parts, F.lit(j)) for j in range(k)])).otherwise(hashed)
    known = known.withColumn("h", hashed)

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", words_of(F.col("text")).alias("words"))
    # One sentinel a document, before its words, meets the template -1, so that documents without matches stay.
    rows = rows.withColumn("padded", F.concat(F.array(F.lit("")), "words"))
    placed = rows.select("_row", "doc_id", "words", F.posexplode(rolling(sizes)).alias("_at", "_w")).withColumn("_at", F.col("_at") - 1)
    word = lambda j: F.col("_w").getField("padded" if not j else str(j))
    gram = lambda k: F.when(F.col("_at") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*[word(j) for j in range(k)]))
    seen = placed.select("_row", "doc_id", "words", F.col("_at").alias("pos"), F.explode(F.array(*[gram(k) for k in sizes])).alias("gram_hash"))
    hits = seen.join(F.broadcast(known), F.col("gram_hash") == F.col("h")).select(
        "_row",
        "doc_id",
        F.size("words").alias("n_words"),
        "template",
        "at",
        "k",
        "length",
        "base",
        "least",
        "label",
        "pos",
        (F.when(F.col("template") < 0, F.lit(True)).otherwise(F.array_join(F.slice("words", F.col("pos") + 1, F.col("k")), " ") == F.col("gram"))).alias("same"),
    ).where("same")

    keys = ["_row", "doc_id", "n_words", "template", "length", "base", "least", "label"]
    votes = hits.groupBy(*keys, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("pos"), F.col("pos") + F.greatest(F.col("k"), F.lit(1)) - 1))))).alias("matched"),
        F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.greatest(F.col("k"), F.lit(1)) - 1)))).alias("covered"),
    )
    order = Window.partitionBy(*keys).orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(order) > drift) | F.col("base") | F.lag("diagonal").over(order).isNull()
    chained = votes.withColumn("chain", F.sum(far.cast("int")).over(order))
    spans = (
        chained.groupBy(*keys, "chain")
        .agg(F.array_distinct(F.flatten(F.collect_list("matched"))).alias("m"), F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"))
        .withColumn("share", F.when(F.col("length") > 0, F.size("covered") / F.col("length")).otherwise(0.0))
        .where((F.col("template") < 0) | (F.col("share") >= F.col("least") - 1e-9))
        .withColumn("first", F.array_min("m"))
        .withColumn("last", F.array_max("m"))
    )
    found, base = F.col("template") >= 0, F.col("base")
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return spans.groupBy("_row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(found).alias("labels"),
        F.max("share").cast("double").alias("score"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(found, F.struct("first", "last", "label")))),
                lambda s: F.concat(s["label"], F.lit(":"), s["first"].cast("string"), F.lit("-"), s["last"].cast("string")),
            ),
            " ",
        ).alias("spans"),
    ).drop("_row")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License findings in every document."""
    return scan(spark, table(spark, sf_dir, "documents"))
