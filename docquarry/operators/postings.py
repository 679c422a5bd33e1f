"""A positional inverted index in Parquet: built by generations, read by the buckets of the asked terms.

Below the index's folder:

* `postings/gen=/bucket=`: blocks (term, grp, n, max_tf, min_len, ids, lens, ends, places). A block holds a term's
  places in the documents of one group, one after another; those of its k-th document end at the
  k-th of `ends`. Documents are dealt to groups of about GROUP by hash, the same for all terms, so
  that a group's bound is the sum of its blocks' bounds. Whole numbers are delta-packed and sorted
  terms prefix-coded by the file format.
* `terms/gen=/bucket=`: (term, df, cf), the dictionary.
* `grams/gen=/bucket=`: (gram, term), the character n-grams of the dictionary's terms.
* `docs/gen=`: (doc_id, length), written last: a generation without it doesn't count.

Ends of sentences are the term "." at the place of the word after it; the term "" is in every document once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.search import B, K1
from docquarry.staging import passing_shuffles

BUCKETS, GRAM_BUCKETS, GROUP, GRAM = 32, 8, 2048, 3
#: Documents that a task inverts, and writes a file a bucket of; few documents still go to up to SPREAD tasks.
TASK_DOCS, SPREAD = 1 << 15, 64
#: Words of a block's documents held at once; a group with more comes in several blocks a term.
PART_WORDS = 1_000_000
END, EVERY = ".", ""
_MARK = b"\x01"
_ENDING = re.compile(rb"[.!?]+(?=[ \t\r\n]|\Z)")
_PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c == 1 else 32 for c in range(256))


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def _bucket(term: Column | str, buckets: int) -> Column:
    return (F.crc32(F.col(term).cast("binary") if isinstance(term, str) else term.cast("binary")) % buckets).cast("int")


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _split(text: str) -> list[bytes]:
    """"" once, then words and marks of ends of sentences in their order."""
    return [b"", *_ENDING.sub(b" \x01 ", text.encode().replace(_MARK, b" ")).translate(_PLAIN).split()]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _numbers() -> _Numbers:
    return _Numbers({b"": 0, _MARK: 1})


def _invert(group: int, docs: list[tuple[int, np.ndarray]], known: _Numbers) -> pa.RecordBatch:
    """Blocks of some documents of a group, of numbers of known words: sorted by term, keeping the order of documents and places."""
    size = np.array([len(words) for _, words in docs])
    term = np.concatenate([words for _, words in docs])
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), size)
    before = np.concatenate((np.zeros(1, np.int32), np.cumsum(term > 1, dtype=np.int32)))
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = before[:-1] - before[first][doc]
    length = before[np.cumsum(size)] - before[first]
    order = np.argsort(term, kind="stable").astype(np.int32)
    term, doc, place = term[order], doc[order], place[order]
    run = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(doc) != 0)))
    tfs = np.diff(np.append(run, len(term)))
    block = np.flatnonzero(np.append(True, np.diff(term[run]) != 0))
    n = np.diff(np.append(block, len(run)))
    ids, lens = np.array([d for d, _ in docs], np.int64)[doc[run]], length[doc[run]]
    ends = run + tfs - np.repeat(run[block], n)
    words = [END if w == _MARK else w.decode() for w in known]
    columns = {
        "term": pa.array([words[t] for t in term[run][block].tolist()], pa.string()), "grp": pa.array(np.full(len(block), group), pa.int32()), "n": pa.array(n, pa.int32()),
        "max_tf": pa.array(np.maximum.reduceat(tfs, block), pa.int32()), "min_len": pa.array(np.minimum.reduceat(lens, block), pa.int32()),
        "ids": _lists(ids, block, pa.int64()), "lens": _lists(lens, block, pa.int32()), "ends": _lists(ends, block, pa.int32()), "places": _lists(place, run[block], pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


BLOCK = "term string, grp int, n int, max_tf int, min_len int, ids array<long>, lens array<int>, ends array<int>, places array<int>"


#: Columns of the tables' files.
TABLES = {"postings": BLOCK, "terms": "term string, df long, cf long", "grams": "gram string, term string", "docs": "doc_id long, length int"}


def _inverter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, doc_id, lower-cased text), sorted by group, to blocks."""
    # Words are held as numbers of 4 bytes: as Python's strings they would take some ten times that.
    group, held, words, known = None, [], 0, _numbers()
    for batch in batches:
        groups, docs = (batch.column(i).to_pylist() for i in (0, 1))
        for at in range(batch.num_rows):
            g, doc, text = groups[at], docs[at], batch.column(2)[at].as_py()
            if g == group and held and held[-1][0] == doc:
                words -= len(held.pop()[1])
            elif held and (g != group or words >= PART_WORDS):
                yield _invert(group, held, known)
                held, words, known = [], 0, _numbers()
            group, split = g, _split(text or "")
            held.append((doc, np.fromiter(map(known.__getitem__, split), np.int32, len(split))))
            words += len(split)
    if held:
        yield _invert(group, held, known)


def grams_of(term: Column, size: int = GRAM) -> Column:
    """Distinct character n-grams of ^term$."""
    marked = F.concat(F.lit("^"), term, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - size + 1), lambda i: F.substring(marked, i, F.lit(size))))


@dataclass(frozen=True)
class Index:
    """An index in a folder that all executors reach."""

    spark: SparkSession
    path: str

    def generations(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/docs")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n[4:]) for n in names if n.startswith("gen=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/docs/{n}/_SUCCESS")))

    def table(self, name: str) -> DataFrame:
        found = self.generations()
        if not found:
            raise ValueError(f"there is no index in {self.path}")
        schema = f"{TABLES[name]}, gen int" + ("" if name == "docs" else ", bucket int")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/gen={g}" for g in found])

    def add(self, docs: DataFrame) -> int:
        """Index the documents whose doc_id isn't indexed yet, as a generation of its own, and give
        how many there were. Rows without a doc_id aren't indexed; of rows that share one the
        greatest text is. A document whose text has changed needs a new index."""
        found = self.generations()
        gen = max(found, default=-1) + 1
        new = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        if found:
            new = new.join(self.table("docs").select("doc_id"), "doc_id", "left_anti")
        count = new.select("doc_id").count()
        if not count and found:
            return 0
        groups = -(-count // GROUP) or 1
        tasks = max(-(-count // TASK_DOCS), min(SPREAD, -(-groups // 2)))
        # Rows of one doc_id come to one group, sorted by text, of which the last is taken.
        dealt = new.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("grp"), "doc_id", F.lower("text").alias("text")).repartition(tasks, "grp").sortWithinPartitions("grp", "doc_id", "text")
        at = lambda name: f"{self.path}/{name}/gen={gen}"
        part = lambda name: self.spark.read.schema(f"{TABLES[name]}, bucket int").parquet(at(name))
        with passing_shuffles(self.spark):
            # Texts are shuffled once, blocks never: each task writes its own file of a bucket, sorted by term.
            blocks = dealt.mapInArrow(_inverter, BLOCK).withColumn("bucket", _bucket("term", BUCKETS)).sortWithinPartitions("bucket", "term", "grp")
            blocks.write.mode("overwrite").option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").partitionBy("bucket").parquet(at("postings"))
            read = part("postings")
            terms = read.where(~F.col("term").isin(END, EVERY)).groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.sum(F.get("ends", F.size("ends") - 1)).cast("long").alias("cf"))
            terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(at("terms"))
            # Terms are shuffled, not their grams, which are several times as many.
            grams = part("terms").select("term").repartition(max(BUCKETS, tasks), "term").select(F.explode(grams_of(F.col("term"))).alias("gram"), "term").withColumn("bucket", _bucket("gram", GRAM_BUCKETS))
            grams.sortWithinPartitions("bucket", "gram", "term").write.mode("overwrite").partitionBy("bucket").parquet(at("grams"))
            every = read.where((F.col("bucket") == bucket_of(EVERY, BUCKETS)) & (F.col("term") == EVERY))
            every.select(F.explode(F.arrays_zip("ids", "lens")).alias("d")).select(F.col("d.ids").alias("doc_id"), F.col("d.lens").alias("length")).write.mode("overwrite").parquet(at("docs"))
        return self.spark.read.parquet(at("docs")).count()

    def statistics(self) -> tuple[int, float]:
        """How many documents there are, and their mean length."""
        row = self.table("docs").agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        return row["n"], row["mean"] or 1.0

    def dictionary(self) -> DataFrame:
        """(term, df, cf) over all generations."""
        return self.table("terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def like(self, pattern: str) -> DataFrame:
        """The terms that match a pattern in which * stands for anything. Pieces of GRAM or more
        characters (ends count) are looked up in the n-grams, whose terms alone are compared with
        the pattern; a pattern without such a piece goes through the dictionary. No text is read."""
        pattern = pattern.lower()
        pieces = ("^" + pattern + "$").split("*")
        asked = sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})
        if asked:
            some = self.table("grams").where(F.col("bucket").isin(sorted({bucket_of(g, GRAM_BUCKETS) for g in asked})) & F.col("gram").isin(asked))
            terms = some.select("gram", "term").distinct().groupBy("term").count().where(F.col("count") == len(asked)).select("term")
        else:
            terms = self.table("terms").select("term").distinct()
        return terms.where(F.col("term").like(pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%")))

    def blocks(self, words: Sequence[str], patterns: Sequence[str] = ()) -> DataFrame:
        """Blocks of the words and of the patterns' terms, with the `leaf` they stand for. Words are
        read from their buckets alone; patterns' terms by a join with what the n-grams give."""
        every = self.table("postings")
        parts = []
        if words:
            parts.append(every.where(F.col("bucket").isin(sorted({bucket_of(w, BUCKETS) for w in words})) & F.col("term").isin(list(words))).withColumn("leaf", F.col("term")))
        for p in patterns:
            terms = self.like(p).withColumn("bucket", _bucket("term", BUCKETS))
            parts.append(every.join(terms, ["bucket", "term"]).withColumn("leaf", F.lit(p)).select(*every.columns, "leaf"))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out


def _documents(placed: bool) -> Column:
    """A block as (ids, lens, tf, places) of its documents, without places unless asked for."""

    def of(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("ends", i - 1)).otherwise(0)
        tf = F.get("ends", i) - before
        places = F.slice("places", before + 1, tf) if placed else F.lit(None).cast("array<int>")
        return F.struct(x.alias("ids"), F.get("lens", i).alias("lens"), tf.alias("tf"), places.alias("places"))

    return F.transform("ids", of)


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def impact(tf: Column, length: Column, mean: float) -> Column:
    """What a term gives to a document's score, but for its weight: more for a greater tf and for a lesser length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def top(index: Index, weights: dict[str, float], k: int, every: bool = False) -> DataFrame:
    """The k best documents by BM25 over the terms, ties to the lesser doc_id; with `every` only
    those that hold all terms.

    Blocks' heads bound what a group of documents can score. The groups of the greatest bounds are
    scored first; of the others only those are read whose bound reaches the k-th score found.
    Returns doc_id, score.
    """
    spark, words = index.spark, list(weights)
    n, mean = index.statistics()
    heads = index.blocks(words)
    df = {r["leaf"]: r["df"] for r in heads.groupBy("leaf").agg(F.sum("n").alias("df")).collect()}
    weight = F.create_map(*[x for w in words for x in (F.lit(w), F.lit(weights[w] * idf(n, df.get(w, 0))))])
    bound = F.max(weight[F.col("leaf")] * impact(F.col("max_tf"), F.col("min_len"), mean))
    groups = heads.groupBy("gen", "grp", "leaf").agg(bound.alias("bound")).groupBy("gen", "grp").agg(F.sum("bound").alias("bound"), F.count("*").alias("held"))
    groups = groups.where(F.col("held") == len(words)) if every else groups

    def scored(blocks: DataFrame) -> DataFrame:
        each = blocks.select("leaf", F.explode(_documents(False)).alias("d"))
        score = weight[F.col("leaf")] * impact(F.col("d.tf"), F.col("d.lens"), mean)
        out = each.groupBy(F.col("d.ids").alias("doc_id")).agg(F.sum(score).alias("score"), F.count("*").alias("held"))
        return (out.where(F.col("held") == len(words)) if every else out).select("doc_id", "score")

    order = [F.desc("score"), F.asc("doc_id")]
    first = groups.orderBy(F.desc("bound"), "gen", "grp").limit(max(2, 2 * k // GROUP)).select("gen", "grp")
    least = scored(heads.join(F.broadcast(first), ["gen", "grp"], "left_semi")).orderBy(*order).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    floor = least["least"] if least["n"] == k else 0.0
    open_ = groups.where(F.col("bound") >= floor * (1 - 1e-9)).select("gen", "grp")
    return scored(heads.join(open_, ["gen", "grp"], "left_semi")).orderBy(*order).limit(k)


class Node:
    """Part of what is asked: a predicate on places, which `search` evaluates over postings."""

    def __and__(self, other: Node) -> Node:
        return All(self, other)

    def __or__(self, other: Node) -> Node:
        return Any(self, other)

    def __invert__(self) -> Node:
        return Not(self)


def _places(leaf: str) -> Column:
    return F.coalesce(F.col("at")[leaf]["places"], F.array().cast("array<int>"))


class Leaf(Node):
    """A condition on the places of some words."""

    patterns: tuple[str, ...] = ()
    placed = True

    def __init__(self, *words: str) -> None:
        self.words = tuple(w.lower() for w in words)

    def test(self) -> Column:
        raise NotImplementedError

    @property
    def leaves(self) -> tuple[str, ...]:
        return self.words + self.patterns

    def matches(self) -> Column:
        present = F.lit(True)
        for leaf in self.leaves:
            present = present & F.col("at")[leaf].isNotNull()
        return F.coalesce(present & self.test(), F.lit(False))

    def score(self, gain: dict[str, Column]) -> Column:
        total = F.lit(0.0)
        for leaf in dict.fromkeys(self.leaves):
            total = total + gain[leaf]
        return F.when(self.matches(), total).otherwise(0.0)

    def parts(self) -> list[Leaf]:
        return [self]

    def positive(self) -> bool:
        return True


class Term(Leaf):
    """A word. Words are indexed as they stand, in lower case, so this is the exact form too."""

    placed = False

    def __init__(self, word: str) -> None:
        super().__init__(word)

    def test(self) -> Column:
        return F.lit(True)


class Wild(Leaf):
    """A word like the pattern, where * stands for anything."""

    placed = False

    def __init__(self, pattern: str) -> None:
        super().__init__()
        self.patterns = (pattern.lower(),)

    def test(self) -> Column:
        return F.lit(True)


class Start(Leaf):
    """The document's first word."""

    def test(self) -> Column:
        return F.array_contains(_places(self.words[0]), 0)


class Phrase(Leaf):
    """The words one after another."""

    def test(self) -> Column:
        rest = list(enumerate(self.words))[1:]
        follows = lambda i: F.coalesce(_all([F.array_contains(_places(w), i + k) for k, w in rest]), F.lit(True))
        return F.exists(_places(self.words[0]), follows)


class Near(Leaf):
    """Two words, in either order, at most `within` places apart."""

    def __init__(self, left: str, right: str, within: int) -> None:
        super().__init__(left, right)
        self.within = within

    def test(self) -> Column:
        left, right = map(_places, self.words)
        return F.exists(left, lambda i: F.exists(right, lambda j: F.abs(i - j) <= self.within))


class Sentence(Leaf):
    """Two words with no end of a sentence between them."""

    def test(self) -> Column:
        left, right = map(_places, self.words)
        ends = _places(END)
        whole = lambda i, j: ~F.exists(ends, lambda e: (e > F.least(i, j)) & (e <= F.greatest(i, j)))
        return F.exists(left, lambda i: F.exists(right, lambda j: whole(i, j)))


def _all(tests: Sequence[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


class Many(Node):
    def __init__(self, *nodes: Node) -> None:
        self.nodes = nodes

    def parts(self) -> list[Leaf]:
        return [p for n in self.nodes for p in n.parts()]

    def score(self, gain: dict[str, Column]) -> Column:
        total = F.lit(0.0)
        for n in self.nodes:
            total = total + n.score(gain)
        return F.when(self.matches(), total).otherwise(0.0)


class All(Many):
    def matches(self) -> Column:
        return _all([n.matches() for n in self.nodes])

    def positive(self) -> bool:
        return any(n.positive() for n in self.nodes)


class Any(Many):
    def matches(self) -> Column:
        return ~_all([~n.matches() for n in self.nodes])

    def positive(self) -> bool:
        return all(n.positive() for n in self.nodes)


class Quorum(Many):
    """At least `least` of the nodes."""

    def __init__(self, least: int, *nodes: Node) -> None:
        super().__init__(*nodes)
        self.least = least

    def matches(self) -> Column:
        return sum((n.matches().cast("int") for n in self.nodes), F.lit(0)) >= self.least

    def positive(self) -> bool:
        return self.least > sum(not n.positive() for n in self.nodes)


class Not(Many):
    def matches(self) -> Column:
        return ~self.nodes[0].matches()

    def score(self, gain: dict[str, Column]) -> Column:
        return F.lit(0.0)

    def positive(self) -> bool:
        return False


class Maybe(Many):
    """The first node; the second only raises the score."""

    def matches(self) -> Column:
        return self.nodes[0].matches()

    def positive(self) -> bool:
        return self.nodes[0].positive()


class Boost(Many):
    """The node, with its score times a weight."""

    def __init__(self, node: Node, weight: float) -> None:
        super().__init__(node)
        self.weight = weight

    def matches(self) -> Column:
        return self.nodes[0].matches()

    def score(self, gain: dict[str, Column]) -> Column:
        return self.nodes[0].score(gain) * self.weight

    def positive(self) -> bool:
        return self.nodes[0].positive()


def search(index: Index, node: Node) -> DataFrame:
    """Documents that match, with the BM25 of the words in those parts that match and aren't negated.

    The words' blocks are turned into one row a document with the places of each word, on which the
    whole expression is one filter. Places are read only if a part of it asks for them. What could
    match a document with none of the words isn't computable from postings and is refused.
    Returns doc_id, score.
    """
    if not node.positive():
        raise ValueError("nothing to match: the search is all negation")
    parts = node.parts()
    words = sorted({w for p in parts for w in p.words})
    patterns = sorted({w for p in parts for w in p.patterns})
    placed = any(p.placed for p in parts)
    ends = any(isinstance(p, Sentence) for p in parts)
    n, mean = index.statistics()
    blocks = index.blocks([*words, END] if ends else words, patterns)
    df = {r["leaf"]: r["df"] for r in blocks.groupBy("leaf").agg(F.sum("n").alias("df")).collect()}
    each = blocks.select("leaf", F.explode(_documents(placed)).alias("d"))
    none = F.lit(None).cast("array<int>")
    if patterns:
        # A pattern's terms may share a document: their counts add, their places mix.
        df |= {r["leaf"]: r["df"] for r in each.where(F.col("leaf").isin(patterns)).groupBy("leaf").agg(F.count_distinct("d.ids").alias("df")).collect()}
        places = F.array_sort(F.flatten(F.collect_list("d.places"))) if placed else none
        each = each.groupBy(F.col("d.ids").alias("doc_id"), "leaf").agg(F.first("d.lens").alias("len"), F.sum("d.tf").alias("tf"), places.alias("places"))
    else:
        each = each.select(F.col("d.ids").alias("doc_id"), "leaf", F.col("d.lens").alias("len"), F.col("d.tf").cast("long").alias("tf"), F.col("d.places").alias("places"))
    docs = each.groupBy("doc_id").agg(F.max("len").alias("len"), F.map_from_entries(F.collect_list(F.struct("leaf", F.struct("tf", "places")))).alias("at"))
    weight = lambda leaf: F.lit(idf(n, df.get(leaf, 0)))
    gain = {leaf: F.coalesce(weight(leaf) * impact(F.col("at")[leaf]["tf"], F.col("len"), mean), F.lit(0.0)) for leaf in [*words, *patterns]}
    return docs.where(node.matches()).select("doc_id", node.score(gain).alias("score"))
