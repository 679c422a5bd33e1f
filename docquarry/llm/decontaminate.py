"""Benchmark decontamination by a prefix-filtered join on rare shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, release, slices, small_batches, table

WINDOW, SHINGLE = 10, 5
#: Remembered hashes of words a worker.
MEMO = 200_000
#: The gate has GATE_PER bits for a shingle that is looked for, but 2^GATE_MOST at most; positions
#: that it lets through wrongly fall out of the join, so its size costs time only.
GATE_PER, GATE_MOST = 64, 27
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8: runs of 0-9, a-z and all beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k words in a row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _hashed(words: list[bytes], memo: _Hashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _windows(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            items, windows = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split_words(text)
                for at in range(max(1, len(words) - size + 1) if words else 0):
                    items.append(item)
                    windows.append(b" ".join(words[at : at + size]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.string())], ["item", "window"])

    return run


def _tokens(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each window's shingles: (window, length, k, off, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            rows = []
            for window in batch.column(0).to_pylist():
                words = split_words(window)
                k = min(shingle, len(words))
                rows += [(window, len(words), k, off, h) for off, h in enumerate(shingle_hashes(_hashed(words, memo), k).view(np.int64).tolist())]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["window", "length", "k", "off", "h"])

    return run


class Gate:
    """Which hashes may be among those looked for, in a bitmap of bounded size. Never says no wrongly."""

    def __init__(self, bits: int, rows: list) -> None:
        self.shift = np.uint64(64 - bits)
        self.map = np.zeros((1 << bits) // 8, np.uint8)
        for r in rows:
            self.map[r["part"] * 4096 : r["part"] * 4096 + 4096] = np.frombuffer(r["bits"], np.uint8)

    @classmethod
    def of(cls, hashes: DataFrame) -> Gate:
        """From the column h. Spark builds the parts of the bitmap; they are all that the driver gets."""
        bits = min(GATE_MOST, max(16, (GATE_PER * max(1, hashes.count()) - 1).bit_length()))
        top = F.shiftrightunsigned("h", 64 - bits)
        parts = hashes.groupBy(F.shiftright(top, 15).alias("part")).agg(F.bitmap_construct_agg(top.bitwiseAND(F.lit(32767))).alias("bits"))
        return cls(bits, parts.collect())

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Indices of hashes that may be looked for."""
        at = (h >> self.shift).astype(np.int64)
        return np.flatnonzero((self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1)


def _counter(gate: Gate, sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(h, n): how often shingles that pass the gate stand in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in slices(batches):
            found = [np.zeros(0, np.uint64)]
            for text in batch.column(0).to_pylist():
                hashes = _hashed(split_words(text), memo)
                for k in sizes:
                    h = shingle_hashes(hashes, k)
                    found.append(h[gate.passes(h)])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return run


HITS = "row long, doc_id long, n_words long, k int, h long, pos long, before int, around string"


def _prober(gate: Gate, sizes: list[int], window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each text one row without a hash, and one for each position whose shingle passes the gate,
    with the words that a window over it could cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        names = [c.split(" ")[0] for c in HITS.split(", ")]
        for batch in slices(batches, 64):
            rows: list[tuple] = []
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = split_words(text)
                hashes = _hashed(words, memo)
                rows.append((row, doc, len(words), None, None, None, None, None))
                for k in sizes:
                    h = shingle_hashes(hashes, k)
                    for pos in gate.passes(h).tolist():
                        first = max(0, pos + k - window)
                        around = b" ".join(words[first : pos + window]).decode("utf-8", "surrogatepass")
                        rows.append((row, doc, len(words), k, int(h[pos].view(np.int64)), pos, pos - first, around))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
                            rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return run


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Where documents hold `window` words in a row of an item, or all of an item that is shorter.

    A set join at full containment: a window's set are its shingles (`shingle` words, or all of
    them). They are ordered by rarity, which is counted over all documents, so the necessary prefix
    is the rarest one; windows with a shingle that stands nowhere fall out at once. Documents meet
    windows only at a prefix shingle, at a place where the window's start and end lie within the
    document; there the words are compared one for one. Both passes over the texts drop what the
    gate, a bitmap of bounded size, excludes; all else is Spark joins, broadcast only where Spark
    knows a side's size to be small.

    Null and empty texts have no words, an item without words has no window. Items of equal item_id
    count once; null item_ids are one item, written as the empty string. Repeated rows and null
    doc_ids are kept as they come, ties cannot arise, other columns are ignored; without documents
    the result is empty.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated.
    """
    small_batches(spark)
    of_item = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInArrow(_windows(window), "item string, window string").distinct()
    of_item = materialize(spark, of_item, "leak-items")
    tokens = materialize(spark, of_item.select("window").distinct().mapInArrow(_tokens(shingle), "window string, length int, k int, off int, h long"), "leak-tokens")
    sizes = sorted(r["k"] for r in tokens.select("k").distinct().collect())
    counted = docs.select("text").mapInArrow(_counter(Gate.of(tokens.select("h").distinct()), sizes), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "h", "off"))
    prefix = tokens.join(counted, "h", "left").groupBy("window", "length", "k").agg(rarest.alias("r")).where("r.n > 0").select("window", "length", "k", "r.h", "r.off")
    prefix = materialize(spark, prefix, "leak-prefixes")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = materialize(spark, rows.mapInArrow(_prober(Gate.of(prefix.select("h").distinct()), sizes, window), HITS), "leak-hits")

    start, inside = F.col("pos") - F.col("off"), F.col("before") - F.col("off")
    met = hits.where("h is not null").join(prefix, ["k", "h"]).where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    same = F.array_join(F.slice(F.split("around", " "), inside + 1, F.col("length")), " ") == F.col("window")
    found = materialize(spark, met.where(same).select("row", start.alias("first"), (start + F.col("length")).alias("end"), "window"), "leak-found")
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    longer = lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["first"], s["upto"]), F.lit(0))).alias("n"), F.greatest(x["end"], s["upto"]).alias("upto"))
    covered = found.groupBy("row").agg(F.aggregate(F.array_sort(F.collect_set(F.struct("first", "end"))), begin, longer)["n"].alias("n_hit"))
    held = found.select("row", "window").distinct().join(of_item, "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("held"))
    each = hits.where("h is null").select("row", "doc_id", "n_words").join(covered, "row", "left").join(held, "row", "left")
    none = F.lit(0).cast("long")
    release(spark, tokens, prefix)
    return each.select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.when(F.col("held").isNull(), none).otherwise(F.size("held").cast("long")).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("held", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"),
    )


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items of the benchmark."""
    return contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL = f"""with b as (select coalesce(item_id::varchar, '') as item, {_WORDS} as w from benchmark),
win as (select distinct item, array_to_string(w[i:i + 9], ' ') as window, least(len(w), 10) as size from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
sizes as (select distinct size from win),
g as (select r, i, size, array_to_string(w[i:i + size - 1], ' ') as window from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes)),
f as (select g.r, g.i, g.size, win.item from g join win on g.window = win.window and g.size = win.size),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + size)) as p from f) group by r),
its as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from f group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on d.r = hit.r left join its on d.r = its.r"""
