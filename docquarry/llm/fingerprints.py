"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests.

All of it is DataFrame and SQL functions. A text is cut into paragraphs (lines, and within a line
stretches of WORDS words), a digest names a paragraph and how often it occurs. A sketch adds each
digest to one cell of each of three parts: a count, the exclusive or of the digests, and of their
check sums. Two sketches subtract cell by cell; cells that hold one digest are peeled off, which
uncovers others, until the digests in which the texts differ are all recovered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, positions, table, text_hash

WORDS = 24
#: Paragraphs of a text: up to WORDS words of one line with the white space before them, then white space at the end.
PARAGRAPH = r"\s*+\S++(?:[^\S\n]++\S++){0,%d}|\s++" % (WORDS - 1)
#: Cells of the fingerprint; of each block of a larger sketch, and the digests that a block is
#: meant for at first. A sketch that fails is followed by one of twice as many blocks.
SMALL, LARGE, LOAD = 24, 120, 24
#: Seeds of the cell choice in both, of the blocks and of the check sums.
SEED_SMALL, SEED_LARGE, SEED_BLOCK, SEED_CHECK = 100, 200, 300, 400
#: Rounds of peeling: what is left after them counts as a failure.
ROUNDS = 24


def paragraphs(text: Column) -> Column:
    """Hashes of the paragraphs, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p))


def _cell(digest: Column, part: int, cells: int, seed: int) -> Column:
    width = cells // 3
    return (F.pmod(F.xxhash64(digest, F.lit(seed + part)), F.lit(width)) + part * width).cast("int")


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(SEED_CHECK))


def peel(cells: Column, size: int, seed: int) -> Column:
    """How many digests a difference of sketches holds, by recovering all of them; -1 if some stay.

    cells: array of (cell, c, k, x), those that nothing fell in may be missing.
    """

    def step(state: Column, _: Column) -> Column:
        pure = F.array_distinct(
            F.transform(
                F.filter(state["cells"], lambda c: (F.abs(c["c"]) == 1) & (c["x"] == _check(c["k"]))),
                lambda c: F.struct(
                    c["c"].alias("c"), c["k"].alias("k"), _check(c["k"]).alias("x"), *[_cell(c["k"], j, size, seed).alias(f"p{j}") for j in range(3)]
                ),
            )
        )

        def take(cell: Column, found: Column) -> Column:
            own = F.filter(found, lambda p: (p["p0"] == cell["cell"]) | (p["p1"] == cell["cell"]) | (p["p2"] == cell["cell"]))
            less = lambda a, p: F.struct(
                a["cell"].alias("cell"), (a["c"] - p["c"]).alias("c"), a["k"].bitwiseXOR(p["k"]).alias("k"), a["x"].bitwiseXOR(p["x"]).alias("x")
            )
            return F.aggregate(own, cell, less)

        def after(found: Column) -> Column:
            left = F.when(F.size(found) == 0, state["cells"]).otherwise(F.transform(state["cells"], lambda c: take(c, found)))
            return F.struct(left.alias("cells"), (state["n"] + F.size(found)).alias("n"), (F.size(found) == 0).alias("done"))

        return F.when(state["done"], state).otherwise(F.get(F.transform(F.array(pure), after), F.lit(0)))

    start = F.struct(cells.alias("cells"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    empty = lambda c: (c["c"] == 0) & (c["k"] == 0) & (c["x"] == 0)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(F.forall(s["cells"], empty), s["n"]).otherwise(F.lit(-1))
    )


def _with_next(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """_id, _hash, copies, text, and of the document next in descending doc_id: its first characters
    (as many as the last third of this one) and its paragraphs."""
    key = ["_id", "_hash"]
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), text_hash().alias("_hash"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    narrow = texts.groupBy(*key).agg(F.count("*").alias("copies"), F.max(F.length("text")).cast("long").alias("n_chars"))
    placed = positions(spark, narrow, key, "fingerprints")
    rows = placed.count()
    giver = placed.select(F.col("_id").alias("g_id"), F.col("_hash").alias("g_hash"), F.col("n_chars").alias("g_n"), F.pmod(F.col("pos") + 1, F.lit(max(rows, 1))).alias("pos"))
    gives = placed.join(giver, "pos").select(
        F.col("g_id").alias("_id"), F.col("g_hash").alias("_hash"), F.col("_id").alias("r_id"), F.col("_hash").alias("r_hash"),
        "copies", "n_chars", F.least(F.floor(F.col("n_chars") / 3), F.col("g_n")).cast("int").alias("take"),
    )
    # Rows that repeat doc_id and text are one document until the result.
    one = texts.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy("_id"))).where("_row = 1").drop("_row")
    given = one.join(gives, key).select(
        F.col("r_id").alias("_id"), F.col("r_hash").alias("_hash"), "copies", "n_chars", F.expr("substring(text, 1, take)").alias("head"), paragraphs(F.col("text")).alias("next")
    )
    return one.join(given, key)


def _tagged(side: int) -> Column:
    return F.transform(f"p{side}", lambda h: F.struct(h.alias("h"), F.lit(side).alias("side")))


#: Columns that name a document.
KEY = ["_id", "_hash"]


def _added(digest: Column, sign: int, cells: int, seed: int) -> Column:
    """The three cells that a digest falls in, with what it adds to them."""
    return F.array(*[F.struct(_cell(digest, j, cells, seed).alias("cell"), F.lit(sign).alias("c"), digest.alias("k"), _check(digest).alias("x")) for j in range(3)])


def _on_side(side: int):
    return lambda r: F.struct(F.lit(side).alias("side"), r.alias("r"))


def _small(counts: DataFrame) -> DataFrame:
    """The fingerprints: key, s0 to s2 (cells of the three texts), and d1, d2: the digests in
    which the first differs from the others, -1 where these cells don't tell."""
    none = F.array().cast("array<struct<side:int,r:struct<cell:int,c:int,k:bigint,x:bigint>>>")
    sides = []
    for i in range(3):
        own = F.transform(_added(F.xxhash64("h", f"n{i}"), 1, SMALL, SEED_SMALL), _on_side(i))
        sides.append(F.when(F.col(f"n{i}") > 0, own).otherwise(none))
    # One entry of no text keeps documents without any digest.
    mark = F.array(F.struct(F.lit(-1).alias("side"), F.struct(F.lit(0).alias("cell"), F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("x")).alias("r")))
    cells = counts.select(*KEY, F.explode(F.concat(F.when(F.col("mark"), mark).otherwise(none), *sides)).alias("e")).select(*KEY, "e.side", "e.r")
    cells = cells.groupBy(*KEY, "side", "r.cell").agg(F.sum("r.c").alias("c"), F.bit_xor("r.k").alias("k"), F.bit_xor("r.x").alias("x"))
    whole = cells.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("side", "cell", "c", "k", "x"))).alias("all"))
    own = lambda i: F.transform(F.filter("all", lambda c: c["side"] == i), lambda c: F.struct(c["cell"].alias("cell"), c["c"].alias("c"), c["k"].alias("k"), c["x"].alias("x")))
    whole = whole.select(*KEY, *[own(i).alias(f"s{i}") for i in range(3)])
    maps = whole.withColumns({f"m{i}": F.map_from_entries(F.transform(f"s{i}", lambda c: F.struct(c["cell"], c))) for i in range(3)})

    def less(i: int) -> Column:
        def cell(at: Column) -> Column:
            a, b, null = F.try_element_at("m0", at), F.try_element_at(f"m{i}", at), F.lit(0).cast("long")
            (ac, bc), (ak, bk), (ax, bx) = ((F.coalesce(a[f], null), F.coalesce(b[f], null)) for f in ("c", "k", "x"))
            return F.struct(at.alias("cell"), (ac - bc).alias("c"), ak.bitwiseXOR(bk).alias("k"), ax.bitwiseXOR(bx).alias("x"))

        return F.transform(F.sequence(F.lit(0), F.lit(SMALL - 1)), cell)

    return maps.select(*KEY, "s0", "s1", "s2", *[peel(less(i), SMALL, SEED_SMALL).alias(f"d{i}") for i in (1, 2)])


def _counts(parts: DataFrame, *more: str) -> DataFrame:
    """(key, more, h, mark, n0 to n2): how often each paragraph stands in the three texts. parts are
    dealt by the key, so that neither this nor what follows by key moves them again."""
    mark = F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(-1).alias("side")))
    entries = parts.select(*KEY, *more, F.explode(F.concat(mark, *[_tagged(i) for i in range(3)])).alias("e"))
    return entries.groupBy(*KEY, *more, "e.h").agg(
        (F.count_if(F.col("e.side") == -1) > 0).alias("mark"), *[F.count_if(F.col("e.side") == i).cast("int").alias(f"n{i}") for i in range(3)]
    )


def _larger(parts: DataFrame, asked: DataFrame, turn: int) -> DataFrame:
    """(key, other, blocks, d) by sketches of so many blocks, for asked documents and others: the
    differing digests, -1 if a block fails."""
    sides = F.filter(
        F.array(F.struct(F.lit(1).alias("sign"), F.xxhash64("h", "n0").alias("d"), F.col("n0").alias("n")), F.struct(F.lit(-1).alias("sign"), F.when(F.col("other") == 1, F.xxhash64("h", "n1")).otherwise(F.xxhash64("h", "n2")).alias("d"), F.when(F.col("other") == 1, F.col("n1")).otherwise(F.col("n2")).alias("n"))),
        lambda s: s["n"] > 0,
    )
    entries = _counts(parts.join(asked, KEY), "other", "blocks").select(*KEY, "other", "blocks", F.explode(sides).alias("s"))
    seed = SEED_LARGE + 10 * turn
    block = F.pmod(F.xxhash64("s.d", F.lit(SEED_BLOCK + turn)), F.col("blocks")).cast("int")
    name = [*KEY, "other", "blocks"]
    cells = entries.select(*name, block.alias("block"), F.col("s.sign").alias("sign"), F.explode(_added(F.col("s.d"), 1, LARGE, seed)).alias("r"))
    cells = cells.groupBy(*name, "block", "r.cell").agg(F.sum(F.col("r.c") * F.col("sign")).alias("c"), F.bit_xor("r.k").alias("k"), F.bit_xor("r.x").alias("x"))
    sketches = cells.groupBy(*name, "block").agg(F.sort_array(F.collect_list(F.struct("cell", "c", "k", "x"))).alias("cells"))
    got = sketches.select(*name, peel(F.col("cells"), LARGE, seed).alias("d"))
    return got.groupBy(*name).agg(F.when(F.min("d") >= 0, F.sum("d")).otherwise(-1).cast("int").alias("d"))


def fingerprint_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare.

    The edited text has its last floor(n_chars / 3) characters replaced by the first as many (or
    all) of the next document, descending doc_id, after the last the first. Likeness is that of the
    sets of digests, (a + b - d) / (a + b + d), where peeling the difference of the sketches
    recovers the d digests that differ (two empty texts: 1). Where the fingerprints' own SMALL cells
    don't suffice, larger sketches are made: blocks of LARGE cells, as many as the texts' paragraphs
    ask for, and for those that fail again twice as many blocks, until all are recovered.

    Null text is empty; null doc_ids come last; equal doc_ids go by text_hash; rows that repeat
    both are one document, returned as often as they come; a lone document is its own next; an
    empty table gives an empty result; other columns are ignored.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    joined = _with_next(docs, spark)
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.col("head"))
    parts = joined.select(
        *KEY, "copies", "n_chars", F.sha2(edited, 256).alias("sha"), paragraphs(F.col("text")).alias("p0"), paragraphs(edited).alias("p1"), F.col("next").alias("p2")
    )
    parts = materialize(spark, parts, "fingerprint-parts")
    small = materialize(spark, _small(_counts(parts.repartition(*KEY))), "fingerprint-sketches")

    size = lambda i: (F.aggregate(f"s{i}", F.lit(0).cast("long"), lambda a, c: a + c["c"]) / 3).cast("int")
    sizes = small.withColumns({f"z{i}": size(i) for i in range(3)})
    open_ = [
        sizes.where(F.col(f"d{i}") < 0).select(*KEY, F.lit(i).alias("other"), F.greatest(F.lit(1), F.ceil((F.col("z0") + F.col(f"z{i}")) / LOAD)).cast("int").alias("blocks")) for i in (1, 2)
    ]
    asked = open_[0].unionByName(open_[1])
    known, turn = None, 0
    while True:
        got = materialize(spark, _larger(parts, asked, turn), f"fingerprint-peeled-{turn}")
        done = got.where("d >= 0").select(*KEY, "other", "d")
        known = done if known is None else known.unionByName(done)
        asked = got.where("d < 0").select(*KEY, "other", (F.col("blocks") * 2).alias("blocks"))
        if asked.isEmpty():
            break
        turn += 1
    large = known.groupBy(*KEY).agg(*[F.max(F.when(F.col("other") == i, F.col("d"))).alias(f"l{i}") for i in (1, 2)])

    text = lambda i: F.array_join(
        F.transform(f"s{i}", lambda c: F.concat_ws(".", F.hex(c["cell"]), F.hex(c["c"]), F.hex(c["k"]), F.hex(c["x"]))), ":"
    )
    measured = parts.select(*KEY, "copies", "n_chars", "sha").join(sizes, KEY).join(large, KEY, "left").withColumns({f"d{i}": F.when(F.col(f"d{i}") >= 0, F.col(f"d{i}")).otherwise(F.col(f"l{i}")) for i in (1, 2)})
    near = lambda i: F.when(F.col("z0") + F.col(f"z{i}") == 0, F.lit(1.0)).otherwise(
        (F.col("z0") + F.col(f"z{i}") - F.col(f"d{i}")) / (F.col("z0") + F.col(f"z{i}") + F.col(f"d{i}"))
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return measured.select(
        F.when(F.col("_id") != -(2**63), F.col("_id")).cast(kind).alias("doc_id"),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        text(0).alias("fingerprint"),
        text(1).alias("edited_fingerprint"),
        near(1).alias("near_edited"),
        near(2).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_documents(spark, table(spark, sf_dir, "documents"))
