"""Counts of linked texts where a passage links all that hold it, without listing the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, release

#: Sets of a text up to which its links are counted by all parts of them (2 to that power rows); texts
#: with more are joined with those that share a set. Both ways give the same counts.
PARTS = 8
#: Texts of a set up to which its links are listed as pairs.
LISTED = 8


def holders(spark: SparkSession, spans: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(key, sets: of over LISTED texts, that each text belongs to), (key, other: pairs of texts of
    smaller sets, in both directions), from spans (hub, key, lo, hi): words lo to hi - 1 of a hub,
    with which the text was aligned.

    Two texts are in a set together exactly if spans of theirs have `least` words of a hub in common,
    or one is a hub of the other. Spans, shortened by `least`, are intervals, and those that all meet
    are the maximal cliques: they end where an end follows a start. Starts and ends are made distinct
    first, so that what is sorted by hub is bounded by its words, not by its holders. Cliques of the
    same texts are one set, named by 64 bits of their number and two sums of hashes. A set within
    another links nothing more and is left out.
    """
    short = materialize(spark, spans.select("hub", "key", "lo", (F.col("hi") - least).alias("to")).distinct(), "link-spans")
    ends = short.select("hub", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(0).alias("end")), F.struct(F.col("to").alias("at"), F.lit(1).alias("end")))).alias("e"))
    ends = ends.select("hub", "e.*").distinct().withColumn("_last", F.lag("end").over(Window.partitionBy("hub").orderBy("at", "end")))
    points = ends.where("end = 1 and _last = 0").groupBy("hub").agg(F.collect_list("at").alias("_points"))
    kinds = short.select("hub", "lo", "to").distinct().join(points.hint("merge"), "hub")
    kinds = kinds.select("hub", "lo", "to", F.explode(F.expr("filter(_points, p -> p between lo and to)")).alias("point"))
    members = short.join(kinds.hint("merge"), ["hub", "lo", "to"]).select("hub", "point", "key")
    members = materialize(spark, members.unionByName(kinds.select("hub", "point", F.col("hub").alias("key"))).distinct(), "link-members")
    named = members.groupBy("hub", "point").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("_a"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("_b")
    )
    named = materialize(spark, named.select("hub", "point", "n", F.xxhash64("n", "_a", "_b").alias("set")), "link-cliques")
    few = members.join(named.where(F.col("n") <= LISTED).hint("merge"), ["hub", "point"]).groupBy("hub", "point").agg(F.collect_list("key").alias("_keys"))
    pairs = few.select(F.explode("_keys").alias("key"), "_keys").select("key", F.explode("_keys").alias("other")).where("key != other").distinct()
    pairs = materialize(spark, pairs, "link-pairs")
    many = members.join(named.where(F.col("n") > LISTED).hint("merge"), ["hub", "point"]).groupBy("key").agg(F.collect_set(F.struct("n", "set")).alias("_sets"))
    many = materialize(spark, many, "link-many")
    out = materialize(spark, _widest(many), "link-sets")
    release(spark, short, members, named, many)
    return out, pairs


def _widest(many: DataFrame) -> DataFrame:
    """(key, sets) of (key, _sets: n, set), without the sets that lie within another one.

    What holds a set is held by each of its texts: so the larger sets of that text of it which has
    fewest are tried, those that its texts of the least and the largest key belong to too. What stays
    is counted over all texts. Lists of sets go to a few texts of each set, not to all.
    """
    single = many.select("key", F.size("_sets").alias("_s"), F.explode("_sets").alias("s")).select("key", "_s", "s.n", "s.set")
    asked = single.groupBy("set", "n").agg(F.min_by("key", F.struct("_s", "key")).alias("_w"), F.min("key").alias("_lo"), F.max("key").alias("_hi"))
    larger = F.expr("transform(filter(_sets, x -> x.n > n), x -> x.set)")
    for witness in ("_w", "_lo", "_hi"):
        asked = asked.join(many.select(F.col("key").alias(witness), "_sets").hint("merge"), witness)
        asked = asked.withColumn("_larger", larger if witness == "_w" else F.array_intersect("_larger", larger)).where(F.size("_larger") > 0).drop("_sets", witness)
    asked = asked.select("set", "n", F.explode("_larger").alias("in"))
    common = single.select("key", "set").join(asked.hint("merge"), "set").join(single.select("key", F.col("set").alias("in")).hint("merge"), ["key", "in"])
    within = common.groupBy("set", "n", "in").agg(F.count("*").alias("_c")).where("_c = n").select("set").distinct()
    return single.join(within.hint("merge"), "set", "left_anti").groupBy("key").agg(F.array_sort(F.collect_set("set")).alias("sets"))


def within_reach(spark: SparkSession, held: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, reach): the sizes, summed, of all texts that share a set with each text, itself included;
    (many, id): names of sets of over PARTS, each with all that share one.

    Texts of the same sets are one row. Rows of up to PARTS sets are counted by inclusion and
    exclusion: what holds a part of the sets, summed over all parts with alternating signs, so that
    rows grow with the texts and not with pairs of them. Pairs of which one has more sets are joined.
    """
    kinds = held.join(sizes.hint("merge"), "key").groupBy("sets").agg(F.sum("size").alias("w")).withColumn("id", F.xxhash64("sets"))
    kinds = materialize(spark, kinds, "link-kinds")
    few = F.size("sets") <= PARTS
    parts = kinds.where(few).select(
        "id", "w", F.explode(F.expr("transform(sequence(1, shiftleft(1, size(sets)) - 1), m -> struct(xxhash64(filter(sets, (x, i) -> shiftright(m, i) % 2 = 1)) as part, if(bit_count(m) % 2 = 1, 1, -1) as sign))")).alias("p")
    ).select("id", "w", "p.*")
    held_by = parts.groupBy("part").agg(F.sum("w").alias("n"))
    counted = parts.join(held_by.hint("merge"), "part").groupBy("id").agg(F.sum(F.col("n") * F.col("sign")).alias("n"))
    single = kinds.select("id", "w", few.alias("few"), F.explode("sets").alias("set"))
    many = single.where("not few").select(F.col("id").alias("many"), F.col("w").alias("many_w"), "set")
    pairs = materialize(spark, many.join(single.hint("merge"), "set").select("many", "many_w", "id", "w", "few").distinct(), "link-near")
    sides = pairs.select(F.col("many").alias("id"), F.col("w").alias("n")).unionByName(pairs.where("few").select("id", F.col("many_w").alias("n")))
    reach = counted.unionByName(sides).groupBy("id").agg(F.sum("n").alias("reach"))
    return held.select("key", F.xxhash64("sets").alias("id")).join(reach.hint("merge"), "id").select("key", "reach"), pairs.select("many", "id")


def count_links(spark: SparkSession, spans: DataFrame, pairs: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """(key, n_links) of all keys in pairs or spans: documents of other rows that a text is linked with.

    spans: see `holders`; pairs (key, other), in both directions, of texts linked directly, the same
    key twice for the copies of a text; sizes (key, size): documents of each text. A document that
    is linked in several ways counts once: pairs count where their texts have no set in common.
    """
    held, listed = holders(spark, spans, least)
    pairs = pairs.unionByName(listed).distinct()
    reach, near = within_reach(spark, held, sizes)
    # Sets go along with pairs of texts that have few of them only; with more, their names are looked up.
    few = F.size("sets") <= PARTS
    named = held.select("key", F.xxhash64("sets").alias("_id"), F.when(few, F.col("sets")).alias("_few"))
    other = named.select(F.col("key").alias("other"), F.col("_id").alias("_other"), F.col("_few").alias("_other_few"))
    own = pairs.join(named.hint("merge"), "key", "left").join(other.hint("merge"), "other", "left").where(~F.coalesce(F.arrays_overlap("_few", "_other_few"), F.lit(False)))
    first = F.col("_few").isNull()
    asked = F.col("_id").isNotNull() & F.col("_other").isNotNull() & (first | F.col("_other_few").isNull())
    own = own.select("key", "other", F.when(asked, F.when(first, F.col("_id")).otherwise(F.col("_other"))).alias("many"), F.when(asked, F.when(first, F.col("_other")).otherwise(F.col("_id"))).alias("id"))
    apart = own.where("many is not null").join(near.hint("merge"), ["many", "id"], "left_anti")
    own = own.where("many is null").select("key", "other").unionByName(apart.select("key", "other"))
    own = own.join(sizes.select(F.col("key").alias("other"), "size").hint("merge"), "other")
    direct = own.groupBy("key").agg(F.sum(F.col("size") - (F.col("key") == F.col("other")).cast("long")).alias("n_links"))
    return direct.unionByName(reach.select("key", (F.col("reach") - 1).alias("n_links"))).groupBy("key").agg(F.sum("n_links").alias("n_links"))
