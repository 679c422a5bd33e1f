"""SimHash fingerprints and their near-duplicate groups by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, small_batches, table, text_hash, trimmed, unpacked
from docquarry.llm.components import components

BITS = 64
#: Bit blocks of a fingerprint. Two that differ in at most 3 bits agree in at least 3 of 6 blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Reference fingerprints whose Hamming distances make up the pivot table.
PIVOTS = np.array([xxhash.xxh64_intdigest(str(i).encode(), 42) for i in range(12)], dtype=np.uint64)


def simhash(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text over the XXH64 (seed 42) of the word shingles, repeats included.

    A-Z are lower-cased; words are runs without ASCII white space; fewer words than `width` form
    one shingle, none give 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        hashes = np.array(
            [digest(whole[a:b], 42) for a, b in zip(starts[at : at + (1 << 14)].tolist(), last[at : at + (1 << 14)])],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * votes > n, bitorder="little")
    return int(set_bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((simhash(t.as_py()) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
        yield pa.record_batch(
            {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(found.view(np.int64))}
        )


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def link_bucket(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (pairs of positions) that join all of the bucket's fingerprints that chains of pairs
    at `most` or fewer differing bits connect: a spanning set of them, never all pairs.

    Each fingerprint in turn is held against the later ones through the pivot table: those that it
    is joined with already are passed over, distances to the reference fingerprints that differ by
    over `most` in any coordinate discard a pair, survivors are verified by their bits. The turns
    end when all are joined, in a group of near copies after a few.
    """
    n = len(fps)
    if n == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= most else []
    pivots = np.stack([_popcount(fps ^ p).astype(np.int8) for p in PIVOTS])
    order = np.argsort(pivots[0], kind="stable")
    pivots, sorted_fps = pivots[:, order], fps[order]
    first = pivots[0]
    group = np.arange(n)
    links: list[tuple[int, int]] = []
    groups = n
    for hub in range(n):
        if groups == 1:
            break
        lo, hi = np.searchsorted(first, [first[hub] - most, first[hub] + most + 1])
        at = np.arange(max(lo, hub + 1), hi)
        at = at[group[at] != group[hub]]
        for row in pivots[1:]:
            if not len(at):
                break
            at = at[np.abs(row[at] - row[hub]) <= most]
        if len(at):
            at = at[_popcount(sorted_fps[at] ^ sorted_fps[hub]) <= most]
            joined, one = np.unique(group[at], return_index=True)
            links.extend((int(order[hub]), int(order[i])) for i in at[one])
            group[np.isin(group, joined)] = group[hub]
            groups -= len(joined)
    return links


def _bucket_links(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (t, key): a bucket may go on in the next batch."""
        kept: list[np.ndarray] = [np.empty(0, np.int64)] * 3

        def links(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1
            edges = np.concatenate(([0], cuts, [len(t)]))
            out: list[np.ndarray] = []
            for i in np.flatnonzero(np.diff(edges) > 1):
                one = fp[edges[i] : edges[i + 1]]
                if pairs := link_bucket(one.view(np.uint64), most):
                    out.append(one[np.array(pairs)])
            if out:
                both = np.concatenate(out)
                yield pa.record_batch({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

        for batch in batches:
            now = [np.concatenate((k, c.to_numpy(zero_copy_only=False))) for k, c in zip(kept, batch.columns)]
            t, key, _ = now
            if not len(t):
                continue
            last = int(np.flatnonzero((t != t[-1]) | (key != key[-1]))[-1]) + 1 if (t[0], key[0]) != (t[-1], key[-1]) else 0
            yield from links(*[c[:last] for c in now])
            kept = [c[last:] for c in now]
        if len(kept[0]):
            yield from links(*kept)

    return run


def near_groups(spark: SparkSession, docs: DataFrame, most: int = 3) -> DataFrame:
    """Fingerprint every document and group those that chains of pairs at `most` (up to 3) or fewer
    differing bits connect.

    Equal fingerprints form one class, before anything else. Each class is dealt to 20 buckets by
    the bits of three of its six blocks, which any linked pair shares in at least one; within a
    bucket pivot tables find links. A dense bucket gives fewer links than it has members, so no
    group of copies makes its pairs. Null text is empty (fingerprint 0, linked like any other),
    null doc_ids are fingerprinted and never the least id unless a group has no other, repeated
    rows are returned as often as they come, an empty table gives an empty result.

    Returns doc_id, text_hash (xxhash64), fp (long, the fingerprint's bits), component_id, and the
    long `group` (the least fingerprint's bits) that stands for the component.
    """
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fp = materialize(
        spark,
        docs.select("doc_id", text_hash().alias("text_hash"), F.col("text").cast("binary").alias("text")).mapInArrow(
            trimmed(_fingerprints), f"doc_id {kind}, text_hash long, fp long"
        ),
        "fingerprints",
    )
    classes = materialize(spark, fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    keys = []
    for t, chosen in enumerate(combinations(BLOCKS, 3)):
        mask = sum(((1 << n) - 1) << at for at, n in chosen)
        keys.append(F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    buckets = classes.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.t", "k.key", "fp")
    links = (
        buckets.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(trimmed(_bucket_links(most)), "a long, b long").distinct()
    )
    labels = components(spark, links, "simhash-links")
    # Groups are settled among classes; the written tables let the joins split a class or group of very many rows.
    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    least = materialize(spark, named.groupBy("group").agg(F.min("least").alias("component_id")), "simhash-groups")
    settled = materialize(spark, named.join(least, "group").select("fp", "group", "component_id"), "simhash-classes")
    return fp.join(settled, "fp").select("doc_id", "text_hash", "fp", "component_id", "group")


def keep_one(spark: SparkSession, docs: DataFrame, most: int = 3) -> DataFrame:
    """The documents without near copies: one of each group stays, with all its columns.

    It is the one with the least doc_id (null last), then the least text_hash; of rows that repeat
    both, the one of least hash over all columns.
    """
    rows = near_groups(spark, docs, most)
    first = F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("text_hash").alias("_hash"))
    kept = rows.groupBy("group").agg(F.min(first).alias("k")).select("k.*")
    one = Window.partitionBy("_none", "_id", "_hash").orderBy(F.xxhash64("doc"))
    own = docs.select(F.struct("*").alias("doc"), F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), text_hash().alias("_hash"))
    found = own.join(kept, ["_none", "_id", "_hash"], "left_semi").withColumn("_row", F.row_number().over(one))
    return unpacked(found.where("_row = 1"), docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at 3 or fewer differing bits."""
    found = near_groups(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
