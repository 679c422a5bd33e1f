"""Graphs of messages and trees of folders, as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.intervals import range_join
from docquarry.staging import drop, keep
from docquarry.versioned import n_per_group


def star_edges(nodes: DataFrame, key: str, by: Sequence[str], kind: str) -> DataFrame:
    """Edges of all nodes that share `by` to the least of them: a star, so edges grow with the nodes."""
    hub = F.min(key).over(Window.partitionBy(*by))
    return nodes.where(" and ".join(f"{c} is not null" for c in by)).withColumn("dst", hub).where(F.col(key) != F.col("dst")).select(F.col(key).alias("src"), "dst", F.lit(kind).alias("kind"))


def parent_edges(nodes: DataFrame, key: str, id_column: str, parents: Column, kind: str) -> DataFrame:
    """Edges to the nodes whose ids a node's header names; both ends must exist."""
    named = nodes.select(F.col(key).alias("src"), F.explode(parents).alias("_p"))
    ids = nodes.select(F.col(key).alias("dst"), F.col(id_column).alias("_p"))
    return named.join(ids, "_p").where("src <> dst").select("src", "dst", F.lit(kind).alias("kind")).distinct()


def follow_edges(nodes: DataFrame, key: str, subject: str, at: str, people: str, marked: str, within: int, kind: str = "inferred") -> DataFrame:
    """Edges from a message that is marked as a reply or forward to all on the same subject (over
    three letters) that came before it, strictly, at most `within` seconds, with a person in common.

    A range join on subject and person, so that only rows that share both and lie near meet.
    """
    fair = nodes.where((F.length(subject) > 3) & F.col(at).isNotNull()).select(F.col(key).alias("_k"), F.col(subject).alias("_s"), F.col(at).alias("_at"), F.col(marked).alias("_m"), F.explode(people).alias("_p"))
    later = fair.where("_m").select("_s", "_p", F.col("_k").alias("src"), (F.col("_at") - within).alias("_start"), F.col("_at").alias("_end"))
    earlier = fair.select("_s", "_p", F.col("_k").alias("dst"), F.col("_at").alias("_then"))
    near = range_join(later, earlier, ["_s", "_p"], "_start", "_then", within).where(F.col("_then") < F.col("_end"))
    return near.select("src", "dst", F.lit(kind).alias("kind")).distinct()


def _with_least(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) with the least of each src and its neighbours. Tables are joined by sorting:
    one of small numbers packs so well that its files don't tell what a broadcast takes in the driver."""
    return edges.join(edges.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least")).hint("merge"), "src")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, by star contraction. Each round links
    larger neighbours, then all, to the least around a node, and is written and read back; rounds end
    when no edge changes."""
    down = lambda e: e.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now, mark = keep(down(edges), "component-edges"), None
    while True:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = down(_with_least(both).where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")))
        small = _with_least(large)
        linked = small.select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(small.select("src", F.col("least").alias("dst")))
        before, now = now, keep(down(linked), "component-edges")
        drop(before)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)


def clusters(labels: DataFrame, key: str = "node", label: str = "component") -> DataFrame:
    """(component, size, anchor) of the components with several members."""
    return labels.groupBy(label).agg(F.count("*").alias("size"), F.min(key).alias("anchor")).where("size > 1")


def edge_counts(edges: DataFrame) -> DataFrame:
    """(kind, edges, nodes): how many edges of each kind there are, and nodes that they start from."""
    return edges.groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("nodes"))


def ego(edges: DataFrame, start: int, depth: int = 3, most: int = 50) -> DataFrame:
    """(node, hops) within `depth` hops of a node, the nearest `most`, then by node."""
    return _reached(edges, start, depth).orderBy("hops", "node").limit(most)


def _reached(edges: DataFrame, start: int, depth: int) -> DataFrame:
    """(node, hops) of all nodes within `depth` hops."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "node long, hops int")
    for hop in range(1, depth + 1):
        step = both.join(seen.where(F.col("hops") == hop - 1).select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        seen = seen.unionByName(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
    return seen


def ego_flags(edges: DataFrame, start: int, depth: int = 3, most: int = 50) -> DataFrame:
    """(nodes, more_nodes, more_depth): the size of what `ego` returns, and whether nodes within reach
    were left out, or any lie beyond it."""
    wide = _reached(edges, start, depth + 1)
    inside = F.count_if(F.col("hops") <= depth)
    return wide.agg(F.least(inside, F.lit(most)).cast("long").alias("nodes"), (inside > most).alias("more_nodes"), (F.count_if(F.col("hops") > depth) > 0).alias("more_depth"))


def ancestors(parents: DataFrame, depth: int = 64, most: int = 4096) -> DataFrame:
    """(node, ancestor, hops, truncated) over (node, parent) rows with several parents and cycles.

    Each round goes one hop up from the pairs that the last one found, and keeps only pairs that
    aren't known: work grows with the pairs, not with the ways between them. A node has the fewest
    hops to each ancestor and isn't its own. Nodes that have over `most` ancestors keep the nearest,
    ties by name, and stop; they and nodes with more than `depth` hops above them are truncated.
    """
    edges = keep(parents.select("node", "parent").where("node <> parent").distinct(), "closure-edges")
    up = edges.select(F.col("node").alias("ancestor"), "parent")
    fresh = keep(edges.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("hops")), "closure-pairs")
    known, hops, rounds = fresh, 1, [fresh]
    while True:
        full = known.groupBy("node").count().where(F.col("count") > most).select("node")
        above = fresh.join(full, "node", "left_anti").join(up, "ancestor").select("node", F.col("parent").alias("ancestor")).where("node <> ancestor").distinct()
        fresh = keep(above.join(known, ["node", "ancestor"], "left_anti").withColumn("hops", F.lit(hops + 1)), "closure-pairs")
        rounds.append(fresh)
        if hops == depth or not fresh.limit(1).count():
            break
        known, hops = known.unionByName(fresh), hops + 1
    # What a hop more would have found is truncated, like what is over `most`.
    deep = fresh.select("node").distinct().withColumn("_deep", F.lit(True))
    large = known.groupBy("node").agg((F.count("*") > most).alias("_large"))
    out = n_per_group(known, ["node"], ["hops", "ancestor"], most).join(large, "node").join(deep, "node", "left")
    out = keep(out.select("node", "ancestor", "hops", (F.col("_large") | F.coalesce("_deep", F.lit(False))).alias("truncated")), "closure")
    drop(edges, *rounds)
    return out


def closure(parents: DataFrame, depth: int = 64) -> DataFrame:
    """(node, ancestor, hops) over (node, parent) rows with several parents and cycles: all within `depth` hops."""
    return ancestors(parents, depth, 1 << 62).select("node", "ancestor", "hops")
