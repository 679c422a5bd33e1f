"""Interleaving sources to target weights by Pfair windows and earliest deadline first."""

from __future__ import annotations

import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, positions, table, text_hash, unpacked

#: What a null source is called in the schedule.
NO_SOURCE = "\x00null"
#: Most slots of a cycle of the schedule; weights whose common cycle is longer are rounded to so many parts.
MOST_CYCLE = 1 << 16
#: Slots that one step of the outer fold adds.
STEP = 256


def _let(value: Column, use) -> Column:
    """use(value), the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edf_cycle(spark: SparkSession, shares: list[int]) -> DataFrame:
    """(class, r, at): the slot `at`, of a cycle of sum(shares), of the r-th block of each class of
    sources. Block r of a class with share q of the L slots may run from floor(r L / q) and must
    have run by ceil((r + 1) L / q). The released block of earliest deadline runs; so all deadlines
    are met, and after any slot each class is less than one block from its exact share."""
    length, n = sum(shares), len(shares)
    share = F.array(*[F.lit(q).cast("long") for q in shares])
    of = lambda f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)

    def slot(state: Column, at: Column) -> Column:
        done = lambda i: F.get(state["done"], i)
        own = lambda i: F.get(share, i)
        deadline = lambda i: F.ceil(((done(i) + 1) * length) / own(i)).cast("long")
        released = lambda i: done(i) * length < (at + 1) * own(i)
        choice = F.array_min(of(lambda i: F.when(released(i), F.struct(deadline(i).alias("d"), i.alias("i")))))
        return _let(
            choice["i"],
            lambda i: F.struct(F.transform(state["done"], lambda k, j: F.when(j == i, k + 1).otherwise(k)).alias("done"), F.concat(state["out"], F.array(i)).alias("out")),
        )

    none = F.array().cast("array<int>")

    def stretch(state: Column, first: Column) -> Column:
        slots = F.sequence(first, F.least(first + STEP - 1, F.lit(length - 1)))
        inner = F.aggregate(slots, F.struct(state["done"].alias("done"), none.alias("out")), slot)
        return _let(inner, lambda x: F.struct(x["done"].alias("done"), F.concat(state["out"], x["out"]).alias("out")))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n).alias("done"), none.alias("out"))
    order = F.aggregate(F.sequence(F.lit(0), F.lit(length - 1), F.lit(STEP)), start, stretch, lambda x: x["out"])
    nth = F.row_number().over(Window.partitionBy("class").orderBy("at"))
    return spark.range(1).select(F.posexplode(order).alias("at", "class")).withColumn("r", (nth - 1).cast("int"))


def exact_shares(weights: list[float], members: list[int]) -> list[int]:
    """Whole numbers in proportion to weight times members: exact, weights taken as the decimals they
    are written as, if their sum is at most MOST_CYCLE; else rounded to about so many parts, at least one each."""
    parts = [Fraction(str(w)) * m for w, m in zip(weights, members, strict=True)]
    scale = math.lcm(*[p.denominator for p in parts])
    whole = [int(p * scale) for p in parts]
    whole = [q // math.gcd(*whole) for q in whole]
    if sum(whole) <= MOST_CYCLE:
        return whole
    total = sum(whole)
    rounded = [max(1, round(Fraction(q, total) * MOST_CYCLE)) for q in whole]
    return [q // math.gcd(*rounded) for q in rounded]


def mix_sources(spark: SparkSession, docs: DataFrame, weights: Mapping[str, float] | DataFrame | None = None, block_rows: int = 16) -> DataFrame:
    """Give every document its place in an interleaving of the sources by target weights.

    A source's rows, by doc_id and text hash, form blocks of block_rows (its last may be shorter).
    weights: target share of each source, in any unit, over 0, or a table (source, weight) of them; sources without one weigh 1, and
    without any weights all are equal. Block k of a source of share w may have its turn from
    floor(k / w) and has it before ceil((k + 1) / w); turns are dealt earliest deadline first, so
    that after any turn each source is less than one block from its exact share. Sources of equal
    weight are one class of the schedule, whose blocks they take in turns, which keeps within their
    own windows. The schedule is one cycle of turns, repeated; its size depends on the weights
    alone. Turns of sources that have run dry close up: slots are the turns that are taken, without
    gaps. Only the number of sources of each weight comes to the driver. No row is dropped or
    repeated.

    Null sources are one source of their own; null doc_ids come first; rows that repeat in doc_id
    and text share a key and stand side by side; an empty table gives an empty result.

    Returns doc_id, text_hash (xxhash64), source, block, row, release, deadline, turn, slot (all
    from 0; release, deadline and turn in turns of sources that never run dry).
    """
    rows = docs.select("doc_id", text_hash().alias("text_hash"), F.coalesce(F.col("source"), F.lit(NO_SOURCE)).alias("source"))
    placed = positions(spark, rows, ["source", "doc_id", "text_hash"], "mixing")
    if isinstance(weights, DataFrame):
        given = weights.select("source", F.col("weight").cast("double").alias("_weight"))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in (weights or {}).items()], "source string, _weight double")
    if given.where("_weight <= 0").limit(1).count():
        raise ValueError("weights must be over 0; leave out the rows of a source that isn't wanted")
    sources = placed.groupBy("source").agg(F.min("pos").alias("_first")).join(given, "source", "left").withColumn("_weight", F.coalesce("_weight", F.lit(1.0)))
    sources = materialize(spark, sources.withColumn("_j", F.row_number().over(Window.partitionBy("_weight").orderBy("source")) - 1), "mixing-sources")
    classes = [(r["_weight"], r["n"]) for r in sources.groupBy("_weight").agg(F.count("*").alias("n")).orderBy("_weight").collect()]
    if not classes:
        none = F.lit(0).cast("long")
        return rows.withColumns(dict.fromkeys(["block", "row", "release", "deadline", "turn", "slot"], none))
    shares = exact_shares([w for w, _ in classes], [m for _, m in classes])
    length = sum(shares)
    table_rows = [(w, i, m, q) for i, ((w, m), q) in enumerate(zip(classes, shares, strict=True))]
    named = spark.createDataFrame(table_rows, "_weight double, class int, _m long, _q long")
    schedule = materialize(spark, edf_cycle(spark, shares), "mixing-schedule")

    placed = placed.join(sources.join(named, "_weight"), "source").withColumn("_in", F.col("pos") - F.col("_first"))
    placed = placed.withColumn("block", F.expr(f"_in div {block_rows}")).withColumn("row", F.col("_in") % block_rows)
    blocks = placed.where("row = 0").select("source", "block", "class", "_m", "_q", (F.col("_j") + F.col("_m") * F.col("block")).alias("_k"))
    turned = blocks.withColumn("r", (F.col("_k") % F.col("_q")).cast("int")).join(schedule, ["class", "r"])
    turned = turned.select(
        "source", "block",
        F.expr(f"block * {length} * _m div _q").alias("release"), F.expr(f"((block + 1) * {length} * _m + _q - 1) div _q").alias("deadline"),
        (F.expr(f"(_k div _q) * {length}") + F.col("at")).alias("turn"),
    )
    slots = positions(spark, turned, ["turn"], "mixing-turns").withColumnRenamed("pos", "slot")
    return placed.join(slots, ["source", "block"]).select(
        "doc_id", "text_hash", F.when(F.col("source") != NO_SOURCE, F.col("source")).alias("source"), "block", "row", "release", "deadline", "turn", "slot"
    )


def _places(df: DataFrame, text: Column) -> list[Column]:
    """The key of a row of a source, without nulls."""
    return [
        F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), text.alias("_hash"),
        F.coalesce(F.col("source"), F.lit(NO_SOURCE)).alias("_source"),
    ]


KEY = ["_none", "_id", "_hash", "_source"]


def with_slots(spark: SparkSession, docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = 16) -> DataFrame:
    """The documents with their places, `slot` and `row` of it, in columns: all columns, all rows.

    Files keep no order, so what is written for a later reader carries its place. Rows that repeat
    in source, doc_id and text are equal, and take the places of their key in any order. Columns of
    documents that are called slot or row are replaced.
    """
    mixed = mix_sources(spark, docs, weights, block_rows)
    placed = mixed.groupBy(*_places(mixed, F.col("text_hash"))).agg(F.array_sort(F.collect_list(F.struct("slot", "row"))).alias("_at"))
    keyed = docs.select(F.struct("*").alias("doc"), *_places(docs, text_hash()))
    # Single rows of a key, nearly all, take its only place; of others each takes the next.
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0)))
    joined = keyed.withColumn("_nth", nth).join(placed, KEY).withColumn("_at", F.element_at("_at", F.col("_nth")))
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("slot", "row")]
    return joined.select(*kept, F.col("_at.slot").alias("slot"), F.col("_at.row").alias("row"))


def mixed_order(spark: SparkSession, docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = 16) -> DataFrame:
    """The documents range-partitioned and sorted by their places: all columns, all rows, whatever the columns are called."""
    placed = with_slots(spark, docs.select(F.struct("*").alias("doc"), "doc_id", "text", "source"), weights, block_rows)
    return unpacked(placed.repartitionByRange("slot", "row").sortWithinPartitions("slot", "row"), docs.columns)


def tempered_weights(docs: DataFrame) -> DataFrame:
    """(source, weight): for each source the power of two nearest to the square root of its rows, so that
    large sources weigh more, but less than their size; the schedule has a class for each power alone."""
    rows = docs.groupBy(F.coalesce(F.col("source"), F.lit(NO_SOURCE)).alias("source")).agg(F.count("*").alias("n"))
    return rows.select("source", F.pow(F.lit(2.0), F.round(F.log2("n") / 2)).alias("weight"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents interleaved with target weights near the square roots of the sources' rows, 16 rows a block."""
    docs = table(spark, sf_dir, "documents")
    return mix_sources(spark, docs, tempered_weights(docs)).drop("text_hash")
