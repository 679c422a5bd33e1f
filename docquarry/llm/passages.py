"""Fuzzy passages that documents share: k-mer seeds, collinear chaining, alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, release, row_key, slices, small_batches, table, text_hash, whole_groups
from docquarry.llm.components import components
from docquarry.llm.links import count_links

#: Words of a seed. Of the K-mers every EVERYth by hash is a seed, whatever stands around it, so that
#: edits near by don't change the choice; where none comes for GAP of them, the least of those is one too.
K, EVERY, GAP = 5, 7, 20
#: Cost, in matched words, of each word that a chain skips, on the mean of its sides.
SKIP_COST = 0.1
#: Words of the shortest passage, and the share of them that its alignment must match.
LEAST_WORDS, LEAST_SHARE = 30, 0.8
#: Words beyond a chain's ends that its alignment may take in; words that it may skip at once.
MARGIN, RESYNC = 64, 8
#: Places of a seed up to which all of them are paired in one row. Beyond, they are compared by blocks,
#: where the first place of equal runs of up to RUN seeds, a hub, links what has enough words in common with it.
PAIRED, RUN = 8, 4
#: Chains that one row asks a text for, so that the text of a hot passage is spread.
ASKED = 128
#: Bytes hashed at a time.
CHUNK = 1 << 19
_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(odd: int) -> np.ndarray:
    p = np.full(CHUNK + 1, np.uint64(odd))
    p[0] = 1
    return np.multiply.accumulate(p)


def word_ids(text: bytes) -> np.ndarray:
    """A 64-bit identifier of each word (letters and digits, A-Z lower-cased, all beyond ASCII)."""
    return _words(text)[1]


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, identifier) of the words."""
    data = np.frombuffer(text.lower(), np.uint8)
    inside = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, i = [np.empty(0, np.uint64)], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        at, to = starts[i:j] - starts[i], ends[i:j] - starts[i]
        if to[-1] > CHUNK:  # one very long word
            x = np.array([xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())], np.uint64)
        else:
            sums = np.zeros(to[-1] + 1, np.uint64)
            np.cumsum((data[starts[i] : ends[j - 1]].astype(np.uint64) + np.uint64(1)) * _powers(_ODD)[: to[-1]], out=sums[1:])
            x = (sums[to] - sums[at]) * _powers(pow(_ODD, -1, 1 << 64))[at]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
        out.append(x)
        i = j
    return starts, np.concatenate(out)


def repeats(words: np.ndarray, least: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of at least so many equal words of one text; bounds: where texts begin, and the end."""
    new = words[1:] != words[:-1]
    if bounds is not None:
        new[bounds[(bounds > 0) & (bounds < len(words))] - 1] = True
    edges = np.concatenate(([0], np.flatnonzero(new) + 1, [len(words)]))
    many = np.diff(edges) >= least
    return edges[:-1][many], edges[1:][many]


def seeds_of(words: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first word, identifier) of the seeds, of one text or of several, one after another; bounds: where they begin, and the end.

    Of a word that is repeated only the first K and those that end within RESYNC words of the last are seeds, all of
    them: what is aligned from those between is aligned from these too, and each would meet each of every other text.
    """
    n = len(words) - K + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for j in range(K):
        x = (x + words[j : j + n]) * np.uint64(_ODD)
        x ^= x >> np.uint64(29)
    bounds = np.array([0, len(words)]) if bounds is None else bounds
    first, end = repeats(words, K + 1, bounds)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first + 1, 1)
    np.add.at(change, np.maximum(first + 1, end - K - RESYNC + 1), -1)
    inner = np.cumsum(change[:n]) > 0
    chosen = (x % np.uint64(EVERY) == 0) & ~inner
    for j in range(1, K):  # those that would go on into the next text
        cut = bounds[1:] - j
        chosen[cut[(cut >= 0) & (cut < n)]] = False
    chosen[first] = True
    for j in range(RESYNC):
        chosen[np.maximum(first, end - K - j)] = True
    at = np.flatnonzero(chosen)
    # A text's seeds between the places before its first and after its last that could be one.
    long = np.diff(bounds) >= K
    edges = np.concatenate((at, bounds[:-1][long] - 1, bounds[1:][long] - K + 1))
    order = np.argsort(edges, kind="stable")
    edges, side = edges[order], np.repeat([0, 1, 2], [len(at), long.sum(), long.sum()])[order]
    more = []
    free = np.where(inner, np.iinfo(np.uint64).max, x)
    wide = (side[:-1] != 2) & ((np.diff(edges) > GAP) | ((side[:-1] == 1) & (side[1:] == 2)))
    todo = [(int(edges[i]), int(edges[i + 1])) for i in np.flatnonzero(wide).tolist()]
    while todo:
        lo, hi = todo.pop()
        least = lo + 1 + int(free[lo + 1 : hi].argmin())
        if inner[least]:  # none but those of one run
            continue
        more.append(least)
        todo += [gap for gap in ((lo, least), (least, hi)) if gap[1] - gap[0] > GAP]
    if more:
        at = np.sort(np.concatenate((at, np.array(more))))
    return at, x[at]


def runs_of(text: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Names of the runs of two and of RUN seeds from each seed on, in the upper and lower half of a number; 0: its text has no such run."""
    out = np.zeros(len(at), np.uint64)
    x = np.zeros(len(at), np.uint64)
    for j in range(1, RUN):
        n = max(0, len(at) - j)
        x = x[:n] + seeds[j:] + (at[j:] - at[:n]).astype(np.uint64)
        x = x * np.uint64(_ODD)
        x ^= x >> np.uint64(29)
        if j in (1, RUN - 1):
            out[:n] |= np.where(text[j:] == text[:n], (x >> np.uint64(32) | np.uint64(1)) << np.uint64(32 if j == 1 else 0), np.uint64(0))
    return out.view(np.int64)


SEED = {"at": pa.int32(), "seed": pa.int64(), "long": pa.int32(), "next": pa.int64(), "words": pa.binary()}


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each seed, and a text's own one with its number of words (at -1) and 16 bits of the identifier of each: an
    alignment compares few hundred, of which it must match LEAST_WORDS nearly. long:
    at the first seed of a run of LEAST_WORDS or more equal words their number, at its last RESYNC that negated, else 0; next: see `runs_of`."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        size = np.array([len(t) for t in texts], np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1
        for first, last in zip([0, *cuts], [*cuts, len(texts)], strict=True):
            if first < last:
                yield from _seeds_of_texts(texts[first:last], batch.slice(first, last - first).select(["doc_id", "key", "same"]))


def _seeds_of_texts(texts: list[bytes], named: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    starts, words = _words(b"\n".join(texts))
    bounds = np.searchsorted(starts, begin)
    at, seed = seeds_of(words, bounds)
    long = np.zeros(len(at), np.int64)
    start, end = repeats(words, LEAST_WORDS, bounds)
    if len(start):
        for u in range(RESYNC):
            long[np.searchsorted(at, end - K - u)] = start - end
        long[np.searchsorted(at, start)] = end - start
    text = np.searchsorted(bounds, at, side="right") - 1
    shorts = pa.py_buffer((words >> np.uint64(40)).astype(np.uint16))
    shorts = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((2 * bounds).astype(np.int32)), shorts])
    none = np.full(len(texts), -1)
    heads = [pa.array(c.astype(kind.to_pandas_dtype()), kind) for c, kind in zip((none, np.diff(bounds), none * 0, none * 0), list(SEED.values())[:-1], strict=True)]
    yield pa.record_batch([*named.columns, *heads, shorts], [*named.schema.names, *SEED])
    columns = (at - bounds[text], seed.view(np.int64), long, runs_of(text, at, seed))
    columns = [pa.array(c.astype(kind.to_pandas_dtype()), kind) for c, kind in zip(columns, list(SEED.values())[:-1], strict=True)]
    row = pa.array(text)
    yield pa.record_batch([*[c.take(row) for c in named.columns], *columns, pa.nulls(len(row), pa.binary())], [*named.schema.names, *SEED])


def chains(at: list[int], other: list[int]) -> list[list[int]]:
    """Chains of all matches, the best first, of matches sorted by `at`; one alone is a chain too.

    A chain rises on both sides. Its score is K a match less SKIP_COST for the words between; the
    best predecessor of a match is a prefix maximum of a Fenwick tree over the ranks of `other`,
    where scores are kept with the part of the cost that depends on the predecessor.
    """
    ranks = {v: r for r, v in enumerate(sorted(set(other)), 1)}
    size, n = len(ranks), len(at)
    tree: list[tuple[float, int]] = [(-1.0, -1)] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        same = i
        while same < n and at[same] == at[i]:
            best, r = (-1.0, -1), ranks[other[same]] - 1
            while r:
                best = max(best, tree[r])
                r &= r - 1
            gain = best[0] - SKIP_COST * (at[same] + other[same] - 2 * K) / 2
            score[same], back[same] = (K + gain, best[1]) if best[1] >= 0 and gain > 0 else (K, -1)
            same += 1
        for j in range(i, same):  # equal starts never follow each other
            entry, r = (score[j] + SKIP_COST * (at[j] + other[j]) / 2, j), ranks[other[j]]
            while r <= size:
                if tree[r] < entry:
                    tree[r] = entry
                r += r & -r
        i = same
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda j: (-score[j], j)):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = back[j]
        if path:
            out.append(path[::-1])
    return out


def dense_parts(chain: list[int], at: list[int], other: list[int]) -> Iterator[list[int]]:
    """A chain cut where its matches leave out more than an edited stretch of one passage would, or
    drift further than an alignment follows."""
    start = 0
    for i in range(1, len(chain) + 1):
        if i < len(chain):
            x, y = at[chain[i]] - at[chain[i - 1]], other[chain[i]] - other[chain[i - 1]]
            if max(x, y) <= 2 * GAP and abs(x - y) <= RESYNC:
                continue
        yield chain[start:i]
        start = i


def _chainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, other key, place in both of a common seed), sorted by the keys; a row for each chain, with its matches."""
    for (key, other_key, place, other_place), bounds in whole_groups(batches, 2):
        rows = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            a, b = zip(*sorted(set(zip(place[lo:hi].tolist(), other_place[lo:hi].tolist(), strict=True))), strict=True)
            rows += [(key[lo], other_key[lo], [a[i] for i in c], [b[i] for i in c]) for whole in chains(a, b) for c in dense_parts(whole, a, b)]
        if rows:
            keys, others, ats, other_ats = zip(*rows, strict=True)
            ints = pa.list_(pa.int32())
            yield pa.record_batch({"key": pa.array(keys), "other": pa.array(others), "at": pa.array(ats, ints), "other_at": pa.array(other_ats, ints)})


def _equal_run(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    step, at = 32, 0
    while at < n:
        end = min(n, at + step)
        differ = a[at:end] != b[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, step = end, step * 2
    return n


def align(a: np.ndarray, b: np.ndarray, marks: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Passages (lo, hi in a, lo, hi in b) that an alignment along the chain's matches confirms.

    From a match on, equal runs are taken whole; where they end, the nearest point within RESYNC
    words on both sides from which K - 2 words match goes on. Where there is none the passage ends,
    and the next begins at the next match ahead. Equal words before a passage belong to it.
    """
    steps = sorted(((x, y) for x in range(RESYNC) for y in range(RESYNC) if x + y), key=lambda s: (sum(s), abs(s[0] - s[1])))
    out, done_a, done_b = [], 0, 0
    for x, y in marks:
        if x < done_a or y < done_b:
            continue
        before = _equal_run(a[done_a:x][::-1], b[done_b:y][::-1])
        lo, plo = x - before, y - before
        i, j, matched = lo, plo, 0
        while i < len(a) and j < len(b):
            run = _equal_run(a[i:], b[j:])
            i, j, matched = i + run, j + run, matched + run
            done_a, done_b = (i, j) if run else (done_a, done_b)
            near_a, near_b = a[i : i + RESYNC + K].tolist(), b[j : j + RESYNC + K].tolist()
            for u, v in steps:
                if len(near_a) >= u + K - 2 and near_a[u : u + K - 2] == near_b[v : v + K - 2]:
                    i, j = i + u, j + v
                    break
            else:
                break
        n, m = done_a - lo, done_b - plo
        if min(n, m) >= LEAST_WORDS and matched >= LEAST_SHARE * max(n, m):
            out.append((lo, done_a, plo, done_b))
    return out


CHAIN = {"key": pa.int64(), "other": pa.int64(), "at": pa.list_(pa.int32()), "other_at": pa.list_(pa.int32()), "first": pa.int32(), "words": pa.binary()}


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other side's words of each chain, with a margin."""
    for batch in batches:
        rows = []
        for text, asked in zip(batch.column("text"), batch.column("asked").to_pylist(), strict=True):
            words = np.frombuffer(text.as_py(), np.uint16)
            for a in asked:
                first = max(0, a["other_at"][0] - MARGIN)
                rows.append(a | {"first": first, "words": words[first : a["other_at"][-1] + K + MARGIN].tobytes()})
        yield pa.record_batch({n: pa.array([r[n] for r in rows], kind) for n, kind in CHAIN.items()})


def _aligner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages on both sides, for what the alignment of chains confirms."""
    for batch in batches:
        out = []
        for text, asked in zip(batch.column("text"), batch.column("asked").to_pylist(), strict=True):
            words = np.frombuffer(text.as_py(), np.uint16)
            for c in asked:
                own = max(0, c["at"][0] - MARGIN)
                marks = [(x - own, y - c["first"]) for x, y in zip(c["at"], c["other_at"], strict=True)]
                for lo, hi, plo, phi in align(words[own : c["at"][-1] + K + MARGIN], np.frombuffer(c["words"], np.uint16), marks):
                    out += [(c["key"], c["other"], lo + own, hi + own), (c["other"], c["key"], plo + c["first"], phi + c["first"])]
        if out:
            yield pa.record_batch(dict(zip(("key", "other", "lo", "hi"), (pa.array(c, pa.int64()) for c in zip(*out, strict=True)), strict=True)))


def _pairs(held: DataFrame, names: list[str]) -> DataFrame:
    """Matches (key, other, at, other_at) of all places in each bucket of the names, of up to PAIRED places, of other texts."""
    places = held.groupBy(*names).agg(F.collect_list(F.struct("key", "at")).alias("p"))
    match = lambda a, b: F.struct(a["key"].alias("key"), b["key"].alias("other"), a["at"].alias("at"), b["at"].alias("other_at"))
    pairs = F.transform("p", lambda a: F.transform(F.filter("p", lambda b: a["key"] < b["key"]), lambda b: match(a, b)))
    return places.select(F.explode(F.flatten(pairs)).alias("m")).select("m.*")


#: Words kept on each side of a place of a hot seed, places of a block, and pairs of them compared at once.
AROUND, BLOCK, PAIRS = 64, 1 << 14, 1 << 15
PLACE = ["seed", "run", "key", "at", "before", "hub", "chunks"]


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words about each place that is asked for; left: how many of them stand before it."""
    for batch in slices(batches, 64):
        if not batch.num_rows:
            continue
        texts, asked = batch.column("text").to_pylist(), batch.column("asked")
        words = np.frombuffer(b"".join(texts), np.uint16)
        size = np.array([len(t) // 2 for t in texts])
        of = np.repeat(np.arange(len(texts)), asked.value_lengths().to_numpy(zero_copy_only=False))
        columns = asked.flatten().flatten()
        at = columns[PLACE.index("at")].to_numpy().astype(np.int64)
        first, end = np.maximum(0, at - AROUND), np.minimum(size[of], at + K + AROUND)
        edges = np.append(0, np.cumsum(end - first))
        begin = (np.cumsum(size) - size)[of] + first
        about = words[np.repeat(begin - edges[:-1], end - first) + np.arange(edges[-1])]
        about = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((2 * edges).astype(np.int32)), pa.py_buffer(about)])
        yield pa.record_batch([*columns, pa.array((at - first).astype(np.int32)), about], [*PLACE, "left", "words"])


def _hot(spark: SparkSession, places: DataFrame) -> DataFrame:
    """(seed, run, key, at, before, hub, chunks): all places of seeds in over PAIRED of them.

    run: the longest of the runs of one, two and RUN seeds from there that are hot too, and where LEAST_WORDS equal words
    start or end, all such places of the seed; hub: whether it is the first place of that, where words are repeated
    most, so that it has all of the others' repeats; before: how far back the text's place before is. Runs and their
    first places are found among the kinds of places, of the same seeds that follow, and come back by one join."""
    before = F.coalesce(F.col("at") - F.lag("at").over(Window.partitionBy("key").orderBy("at")), F.lit(0)).cast("int")
    held = places.withColumns({"before": before, "_s": F.signum("long").cast("int")}).where(F.col("n") > PAIRED)
    held = materialize(spark, held, "passage-hot-places")
    order = F.struct((-F.abs("long")).alias("l"), "key", "at")
    kinds = held.groupBy("seed", "next", "_s").agg(F.count("*").alias("_c"), F.min(order).alias("_first")).repartition("seed")
    kinds = kinds.withColumns({"_2": F.shiftright("next", 32), f"_{RUN}": F.col("next").bitwiseAND(0xFFFFFFFF)})
    kinds = kinds.withColumn("_n2", F.sum("_c").over(Window.partitionBy("seed", "_2")))
    kinds = kinds.withColumn("_nr", F.sum("_c").over(Window.partitionBy("seed", "_2", f"_{RUN}")))
    run = F.when(F.col("_s") != 0, F.col("_s").cast("long")).when((F.col("_nr") > PAIRED) & (F.col(f"_{RUN}") != 0), F.col("next"))
    run = run.when((F.col("_n2") > PAIRED) & (F.col("_2") != 0), F.shiftleft("_2", 32)).otherwise(F.lit(0).cast("long"))
    kinds = kinds.withColumn("run", run).withColumn("_first", F.min("_first").over(Window.partitionBy("seed", "run")))
    kinds = kinds.select("seed", "next", "_s", "run", "_first")
    hot = held.join(kinds.hint("merge"), ["seed", "next", "_s"]).select(
        "seed", "run", "key", "at", "before", (order == F.col("_first")).alias("hub"), F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")
    )
    hot = materialize(spark, hot, "passage-hot")
    release(spark, held)
    return hot


def _blocks(around: DataFrame) -> DataFrame:
    """Each place in all pairs of blocks (a, b) of its seed that its own block is in, hubs in all there are; own: its block, -1 of a hub that is only looked at."""
    dealt = around.withColumn("own", F.pmod(F.xxhash64("key", "at"), F.col("chunks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    met = F.transform(every, lambda o: F.struct(F.least("own", o).alias("a"), F.greatest("own", o).alias("b"), F.col("own").alias("own")))
    seen = F.flatten(F.transform(every, lambda x: F.transform(F.filter(every, lambda y: (y >= x) & (x != F.col("own")) & (y != F.col("own"))), lambda y: F.struct(x.alias("a"), y.alias("b"), F.lit(-1).alias("own")))))
    dealt = dealt.withColumn("_b", F.explode(F.when(F.col("hub"), F.concat(met, seen)).otherwise(met)))
    return dealt.select("seed", F.col("_b.a").alias("a"), F.col("_b.b").alias("b"), F.col("_b.own").alias("own"), "run", "key", "at", "before", "hub", "left", "words")


def _equal_about(words: np.ndarray, left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words before, and from, the places i and j."""
    same = words[i] == words[j]
    before, after = same[:, AROUND - 1 :: -1], same[:, AROUND:]
    n = np.where(before.all(axis=1), AROUND, before.argmin(axis=1))
    m = np.where(after.all(axis=1), after.shape[1], after.argmin(axis=1))
    return np.minimum(n, np.minimum(left[i], left[j])), np.minimum(m, np.minimum(right[i], right[j]))


def _classes(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the distinct rows of some whole numbers."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= np.diff(c[order]) != 0
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _met(group: np.ndarray, cell: np.ndarray, apart: Callable[[np.ndarray, np.ndarray], np.ndarray], kin: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, up to about PAIRS at once, of one group and of cells that may meet: apart says of two
    rows of a group, each the first of its cell, that no row of one goes with one of the other. Cells are
    numbered by their kin, if given, and those of the same kin never meet."""
    order = np.lexsort((cell, group))
    group, cell = group[order], cell[order]
    first = np.flatnonzero(np.append(True, (np.diff(group) != 0) | (np.diff(cell) != 0))) if len(order) else np.empty(0, np.int64)
    size, of = np.diff(np.append(first, len(order))), group[first]
    last, start = np.searchsorted(of, of, side="right"), np.arange(len(first))
    if kin is not None:
        runs = np.append(np.flatnonzero((np.diff(of) != 0) | (np.diff(kin[order][first]) != 0)) + 1, len(first))
        start = runs[np.searchsorted(runs, start, side="right")]
    for x, y in _ranges(np.arange(len(first)), start, last):
        keep = ~apart(order[first[x]], order[first[y]])
        x, y = x[keep], y[keep]
        # Rows of the first cell, each with all of the second; within one cell each with those after it.
        rows = np.repeat(np.arange(len(x)), size[x])
        i = first[x][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(size[x]) - size[x], size[x])
        same = (x == y)[rows]
        for u, j in _ranges(np.arange(len(rows)), np.where(same, i + 1, first[y][rows]), first[y][rows] + size[y][rows]):
            yield order[i[u]], order[j]


def _ranges(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with every number from its start to before its end, up to about PAIRS at once."""
    sums = np.concatenate(([0], np.cumsum(end - start)))
    at = 0
    while at < sums[-1]:
        to = min(at + PAIRS, int(sums[-1]))
        lo, hi = int(np.searchsorted(sums, at, side="right")) - 1, int(np.searchsorted(sums, to, side="left"))
        left, right = np.maximum(sums[lo:hi], at), np.minimum(sums[lo + 1 : hi + 1], to)
        n = right - left
        which = np.repeat(np.arange(lo, hi), n)
        yield row[which], start[which] + np.arange(at, to) - sums[which]
        at = to


_STEPS = np.array(sorted(((x, y) for x in range(RESYNC) for y in range(RESYNC) if x + y), key=lambda s: (sum(s), abs(s[0] - s[1]))))


class _Places:
    """Places of one or several pairs of blocks, and the passages that those of different texts share."""

    def __init__(self, key: np.ndarray, at: np.ndarray, before: np.ndarray, left: np.ndarray, words: np.ndarray) -> None:
        n = len(key)
        self.key, self.at, self.before, self.left = key, at.astype(np.int64), before, left
        size = np.fromiter(map(len, words), np.int64, n) // 2
        self.right = size - left
        self.words = np.zeros((n, 2 * AROUND + K), np.uint16)
        row = np.repeat(np.arange(n), size)
        self.words[row, np.arange(len(row)) - (np.cumsum(size) - size - AROUND + left)[row]] = np.frombuffer(b"".join(words), np.uint16)
        w = self.words[:, AROUND:].astype(np.uint64)
        grams = np.full((n, w.shape[1] + RESYNC), np.uint64(1) << np.uint64(63), np.uint64) + np.arange(n, dtype=np.uint64)[:, None]
        ends = np.arange(w.shape[1] - 2)[None, :] + 2 < self.right[:, None]
        grams[:, : w.shape[1] - 2][ends] = (w[:, :-2] | w[:, 1:-1] << np.uint64(16) | w[:, 2:] << np.uint64(32))[ends]
        self.grams = grams

    def spans(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, to: np.ndarray, other_to: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        k, o, x, y = self.key[i], self.key[j], self.at[i], self.at[j]
        return [(k, o, x - n, x + to, y - n), (o, k, y - n, y + other_to, x - n)]

    def to_hubs(self, hub: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Words that each place has in common with its hub on both sides, and the passages, of those asked for, with LEAST_WORDS."""
        rows = np.arange(len(hub))
        n, m = _equal_about(self.words, self.left, self.right, rows, hub)
        long = asked & (n + m >= LEAST_WORDS) & (self.key != self.key[hub])
        rows, to = rows[long], hub[long]
        lo = self.at[to] - n[long]
        return n, m, [(self.key[to], self.key[rows], lo, lo + n[long] + m[long], self.at[rows] - n[long])]

    def candidates(self, group: np.ndarray, hub: np.ndarray, hub_n: np.ndarray, hub_m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of a group's places that may share a passage: all that have LEAST_WORDS equal words
        about the seed and aren't known by their hub, and all whose words go on alike in RESYNC words after
        what is equal.

        Places are classed by the words from the seed on, one more at each turn. Two places part at one
        turn, where their class falls apart: there those of equal words before the seed, or of an equal
        gram behind the turn, are brought together, so that pairs without either are never formed.
        Nor are those of one cell: known by their hub, or compared at the seed before.
        """
        n = len(group)
        before = [np.zeros(n, np.int64)]  # by equal words before the seed; what has fewer is alone
        for length in range(1, LEAST_WORDS):
            alone = np.where(self.left < length, np.arange(n) + 1, 0)
            before.append(_classes(before[-1], self.words[:, AROUND - length].astype(np.int64), alone))
        alone = np.arange(n)
        seen = (self.before > 0) & (self.before < LEAST_WORDS) & (self.before <= self.left)
        earlier = np.where(seen, np.array(before)[np.where(seen, self.before, 0), alone], -1 - alone)
        earlier = _classes(np.where(seen, self.before, 0), earlier)
        cell = _classes(hub, hub_n, hub_m, self.before)
        kind, rows = group, np.arange(n)
        for m in range(K, LEAST_WORDS + 1):
            # Only classes that texts meet in go on.
            kind = _classes(kind)
            most, least = np.full(n, np.iinfo(np.int64).min), np.full(n, np.iinfo(np.int64).max)
            np.maximum.at(most, kind, self.key[rows])
            np.minimum.at(least, kind, self.key[rows])
            meet = most[kind] != least[kind]
            rows, kind = rows[meet], kind[meet]
            if not len(rows):
                return
            if m == LEAST_WORDS:
                yield from self._equal(rows, kind, None, cell, 0, earlier, hub, hub_n, hub_m, before)
                return
            child = _classes(kind, self.words[rows, AROUND + m].astype(np.int64), np.where(self.right[rows] > m, 0, rows + 1))
            lead = np.full(n, -1)
            lead[kind] = child
            parts = np.zeros(n, bool)
            parts[kind[lead[kind] != child]] = True
            at = parts[kind]
            if at.any():
                yield from self._equal(rows[at], kind[at], child[at], cell, LEAST_WORDS - m, earlier, hub, hub_n, hub_m, before)
                yield from self._alike(rows[at], kind[at], child[at], m, earlier, before)
            kind = child

    def _equal(self, rows: np.ndarray, kind: np.ndarray, child: np.ndarray | None, cell: np.ndarray, length: int, earlier: np.ndarray, hub: np.ndarray, hub_n: np.ndarray, hub_m: np.ndarray, before: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a class with equal `length` words before the seed, of other children."""
        if length:
            long = self.left[rows] >= length
            rows, child = rows[long], child[long]
            kind = _classes(kind[long], before[length][rows])

        def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            i, j = rows[x], rows[y]
            known = (hub[i] == hub[j]) & (np.minimum(hub_n[i], hub_n[j]) + np.minimum(hub_m[i], hub_m[j]) >= LEAST_WORDS)
            return known | ((self.before[i] == self.before[j]) & (self.before[i] > 0) & (self.before[i] <= length))

        for x, y in _met(kind, cell[rows], apart):
            keep = earlier[rows[x]] != earlier[rows[y]]
            if child is not None:
                keep &= child[x] != child[y]
            yield rows[x[keep]], rows[y[keep]]

    def _alike(self, rows: np.ndarray, kind: np.ndarray, child: np.ndarray, m: int, earlier: np.ndarray, before: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a class, of other children, with an equal gram in the RESYNC words from m on, but those
        that `_equal` gives; each once, with the least of their equal grams."""
        each = np.repeat(np.arange(len(rows)), RESYNC)
        near = self.grams[rows[:, None], m + np.arange(RESYNC)]
        gram = near.ravel()
        real = gram < np.uint64(1) << np.uint64(63)
        each, gram = each[real], gram[real]
        order = np.lexsort((gram, each))
        each, gram = each[order], gram[order]
        new = np.ones(len(each), bool)
        new[1:] = (np.diff(each) != 0) | (np.diff(gram) != 0)
        each, gram = each[new], gram[new]
        which = _classes(kind[each], gram.view(np.int64))
        several = np.bincount(which, minlength=1)[which] > 1
        each, which, gram = each[several], which[several], gram[several]
        equal = before[LEAST_WORDS - m][rows]
        old = earlier[rows]

        def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            x, y = each[x], each[y]
            return (old[x] == old[y]) | (equal[x] == equal[y])

        for x, y in _met(which, _classes(child, old, equal)[each], apart, child[each]):
            g, x, y = gram[x], each[x], each[y]
            keep = self.key[rows[x]] != self.key[rows[y]]
            g, x, y = g[keep], x[keep], y[keep]
            less = np.zeros(len(g), bool)
            for u in range(RESYNC):
                mine = near[x, u]
                less |= (mine < g) & (mine[:, None] == near[y]).any(axis=1)
            yield rows[x[~less]], rows[y[~less]]

    def passages(self, i: np.ndarray, j: np.ndarray, hub: np.ndarray, hub_n: np.ndarray, hub_m: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Passages of pairs of places. Left out are pairs that have LEAST_WORDS words with their hub in
        common, and those that have the seed before in common too, at which they are compared."""
        keep = self.key[i] != self.key[j]
        known = np.minimum(hub_n[i], hub_n[j]) + np.minimum(hub_m[i], hub_m[j]) >= LEAST_WORDS
        keep &= ~(known & (hub[i] == hub[j]))
        i, j = i[keep], j[keep]
        n, m = _equal_about(self.words, self.left, self.right, i, j)
        fresh = ~((self.before[i] == self.before[j]) & (self.before[i] > 0) & (n >= self.before[i]))
        i, j, n, m = i[fresh], j[fresh], n[fresh], m[fresh]
        long = n + m >= LEAST_WORDS
        return self.spans(i[long], j[long], n[long], m[long], m[long]) + self.aligned(i[~long], j[~long], n[~long], m[~long])

    def aligned(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """What `align` confirms about the seeds of pairs with n and m equal words before and from them."""
        out: list[tuple[np.ndarray, ...]] = []
        x, y, matched = m.copy(), m.copy(), n + m
        reach, width = np.arange(RESYNC), np.arange(AROUND + K)
        while len(i):
            near = self.grams[i[:, None], x[:, None] + reach][:, _STEPS[:, 0]] == self.grams[j[:, None], y[:, None] + reach][:, _STEPS[:, 1]]
            on = near.any(axis=1)
            end = ~on & (np.minimum(x, y) + n >= LEAST_WORDS) & (matched >= LEAST_SHARE * (np.maximum(x, y) + n))
            if end.any():
                out += self.spans(i[end], j[end], n[end], x[end], y[end])
            i, j, n, x, y, matched = i[on], j[on], n[on], x[on], y[on], matched[on]
            step = _STEPS[near[on].argmax(axis=1)]
            x, y = x + step[:, 0], y + step[:, 1]
            u, v = np.minimum(x[:, None] + width, AROUND + K - 1), np.minimum(y[:, None] + width, AROUND + K - 1)
            other = self.words[i[:, None], AROUND + u] != self.words[j[:, None], AROUND + v]
            run = np.where(other.any(axis=1), other.argmax(axis=1), AROUND + K)
            run = np.minimum(run, np.minimum(self.right[i] - x, self.right[j] - y))
            x, y, matched = x + run, y + run, matched + run
        return out


def _needed(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of passages those that are the first of their two texts, or the first in a text from word to word:
    places that a text repeats would give each of these once a pair of places."""
    key, other, lo, hi, _ = columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
    first = [np.unique(_classes(*c), return_index=True)[1] for c in ((key, other), (key, lo, hi))]
    kept = np.union1d(*first)
    return tuple(c[kept] for c in columns)


def _found(rows: list[tuple[np.ndarray, ...]], equal: bool) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*rows, strict=True)]
    return pa.record_batch([*columns, pa.array(np.full(len(columns[0]), equal))], ["key", "other", "lo", "hi", "other_lo", "equal"])


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows, but the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _hot_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_blocks`, sorted by (seed, a, b), to the passages of all pairs of places of each pair of blocks."""
    for (seed, a, b, own, run, key, at, before, is_hub, left, words), bounds in whole_groups(_joined(batches, BLOCK), 3):
        at_once = np.unique(np.append(bounds[np.searchsorted(bounds, np.arange(0, bounds[-1], 4 * BLOCK))], bounds[-1]))
        for first, last in zip(np.append(0, at_once[at_once > 0])[:-1].tolist(), at_once[at_once > 0].tolist(), strict=True):
            part = slice(first, last)
            places = _Places(key[part], at[part], before[part], left[part], words[part])
            edges = bounds[(bounds >= first) & (bounds <= last)] - first
            group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            of, hubs = _classes(group, run[part]), np.flatnonzero(is_hub[part])
            hub = np.full(last - first, -1)
            hub[of[hubs]] = hubs
            hub = hub[of]
            hub_n, hub_m, to_hubs = places.to_hubs(hub, (a == b)[part])
            if to_hubs:
                yield _found(to_hubs, True)
            # Hubs that are only looked at stand in groups of their own; two blocks meet each other only.
            own_, two = own[part], (a != b)[part]
            group = np.where(own_ < 0, len(edges) + np.arange(last - first), group)
            out: list[tuple[np.ndarray, ...]] = []
            for i, j in places.candidates(group, hub, hub_n, hub_m):
                met = ~two[i] | (own_[i] != own_[j])
                out += places.passages(i[met], j[met], hub, hub_n, hub_m)
                if sum(len(c[0]) for c in out) >= 8 * PAIRS:
                    out = [_needed(out)]
                    if len(out[0][0]) >= 4 * PAIRS:
                        yield _found(out, False)
                        out = []
            if out:
                out = [_needed(out)]
                yield _found(out, False)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `_hot_passages` finds, but links and stretches by themselves: each two texts once (no lo, hi), and of a text
    the stretches that meet as one (no other)."""
    key, other, lo, hi = (np.empty(0, np.int64) for _ in range(4))
    links, runs = (key, other), (key, lo, hi)
    for found in _hot_passages(batches):
        equal = found.column("equal").to_numpy(zero_copy_only=False)
        if equal.all():
            yield found
            continue
        key, other, lo, hi = (found.column(c).to_numpy() for c in ("key", "other", "lo", "hi"))
        links = _distinct(*(np.concatenate(c) for c in zip(links, (np.minimum(key, other), np.maximum(key, other)), strict=True)))
        runs = _merged(*(np.concatenate(c) for c in zip(runs, (key, lo, hi), strict=True)))
        if len(links[0]) + len(runs[0]) >= 16 * PAIRS:
            yield from _apart(links, runs)
            links, runs = tuple(c[:0] for c in links), tuple(c[:0] for c in runs)
    yield from _apart(links, runs)


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    kept = np.unique(_classes(*columns), return_index=True)[1]
    return tuple(c[kept] for c in columns)


def _merged(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of which those of a text that meet are one."""
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    # Words of one text after those of another, so that one running maximum serves all.
    base = np.cumsum(np.append(0, key[1:] != key[:-1])[: len(key)]) << 32
    reach = np.maximum.accumulate(base + hi)
    first = np.flatnonzero(np.append(True, (base + lo)[1:] > reach[:-1])[: len(key)])
    last = np.append(first[1:], len(key))[: len(first)] - 1
    return key[first], lo[first], reach[last] - base[last]


def _apart(links: tuple[np.ndarray, ...], runs: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    n, m = len(links[0]), len(runs[0])
    whole = lambda a, b: pa.concat_arrays([pa.nulls(n, pa.int64()) if a is None else pa.array(a, pa.int64()), pa.nulls(m, pa.int64()) if b is None else pa.array(b, pa.int64())])
    if n + m:
        columns = [whole(links[0], runs[0]), whole(links[1], None), whole(None, runs[1]), whole(None, runs[2]), whole(None, None)]
        yield pa.record_batch([*columns, pa.array(np.zeros(n + m, bool))], ["key", "other", "lo", "hi", "other_lo", "equal"])


def hot_passages(spark: SparkSession, places: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links and stretches, spans: hub, key, lo, hi of a hub, equal in both) of seeds in over PAIRED places, of all pairs of them.

    Each place goes with the words about it; a seed's places are dealt to blocks, and every two
    blocks are compared in one group of rows, so that memory is bounded however hot a seed is. What
    LEAST_WORDS equal words link by way of the first place of a run isn't listed, but counted by
    sets of holders (`links`); of all other pairs those are aligned whose words go on alike after
    what is equal about the seed (`_Places.candidates`). What is found is held as links (key, other)
    and stretches (key, lo, hi) by themselves (`_gathered`).
    """
    hot = _hot(spark, places)
    salted = hot.withColumn("_salt", F.floor(F.row_number().over(Window.partitionBy("key").orderBy("at")) / ASKED))
    asked = salted.withColumn("_own", F.struct(*PLACE)).groupBy("key", "_salt").agg(F.collect_list("_own").alias("asked"))
    shape = "seed long, run long, key long, at int, before int, hub boolean, chunks int, left int, words binary"
    around = whole.join(asked.hint("merge"), "key").select("text", "asked").mapInArrow(_around, shape)
    dealt = _blocks(around).repartition("seed", "a", "b").sortWithinPartitions("seed", "a", "b")
    found = materialize(spark, dealt.mapInArrow(_gathered, "key long, other long, lo long, hi long, other_lo long, equal boolean"), "passage-hot-found")
    # What is equal to a hub comes in windows about the seeds: those that meet are one run.
    run = Window.partitionBy("key", "other", "by").orderBy("lo", "hi")
    reach = F.max("hi").over(run.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.where("equal").select("key", "other", "lo", "hi", (F.col("other_lo") - F.col("lo")).alias("by")).distinct()
    spans = spans.withColumn("_new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(run))
    spans = spans.groupBy("key", "other", "by", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("key", "other", "lo", "hi", "by")
    spans = materialize(spark, spans, "passage-hub-spans")
    sides = spans.select("key", "other", "lo", "hi").unionByName(spans.select(F.col("other").alias("key"), F.col("key").alias("other"), (F.col("lo") + F.col("by")).alias("lo"), (F.col("hi") + F.col("by")).alias("hi")))
    out = materialize(spark, found.where("not equal").select("key", "other", "lo", "hi").unionByName(sides).distinct(), "passage-hot-sides")
    release(spark, hot, found)
    return out, spans.select(F.col("key").alias("hub"), F.col("other").alias("key"), "lo", "hi")


def _by_text(spark: SparkSession, whole: DataFrame, chains_: DataFrame, side: str) -> DataFrame:
    """(text, asked): each text with the chains that have it on that side, up to about ASKED in a row."""
    counts = materialize(spark, chains_.groupBy(side).agg(F.count("*").alias("_n")).select(side, F.ceil(F.col("_n") / ASKED).cast("int").alias("_salts")), "passage-asked")
    texts = whole.withColumnRenamed("key", side).join(counts.hint("merge"), side).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    other = "other" if side == "key" else "key"
    asked = (
        chains_.withColumn("_own", F.struct(*chains_.columns)).join(counts.hint("merge"), side)
        .withColumn("_salt", F.pmod(F.xxhash64(other, F.element_at("at", 1)), F.col("_salts")).cast("int"))
        .groupBy(side, "_salt").agg(F.collect_list("_own").alias("asked"))
    )
    return texts.select(side, "_salt", "text").join(asked.hint("merge"), [side, "_salt"]).select("text", "asked")


def shared_passages(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, key, same, n_words), (passages: key, other, lo, hi, of words; a link by itself has no lo
    and hi, a stretch by itself no other),
    (spans: hub, key, lo, hi, words of a hub that a text has too, which link all that have LEAST_WORDS of them).

    Documents of equal text are one class, named `same`; passages are those of classes. Matches of
    two classes are chained and aligned; a passage has LEAST_WORDS words or more, LEAST_SHARE of
    them matched.
    """
    small_batches(spark)
    texts = docs.select(
        "doc_id", F.xxhash64(*row_key()).alias("key"), text_hash().alias("same"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(spark, texts.mapInArrow(_seeds, f"doc_id {kind}, key long, same long, at int, seed long, long int, next long, words binary"), "passage-seeds")
    # Each place of a text once, whatever its copies, and n, how many its seed has, with one shuffle.
    order, seed = Window.partitionBy("seed").orderBy("key", "at"), Window.partitionBy("seed")
    seeds = rows.where("at >= 0").select(F.col("same").alias("key"), "at", "seed", "long", "next")
    seeds = seeds.withColumn("_new", F.coalesce((F.col("key") != F.lag("key").over(order)) | (F.col("at") != F.lag("at").over(order)), F.lit(True)))
    places = seeds.withColumn("n", F.sum(F.col("_new").cast("long")).over(seed)).where("_new and n > 1").drop("_new")
    places = materialize(spark, places, "passage-places")
    heads = rows.where("at < 0")
    whole = materialize(spark, heads.groupBy(F.col("same").alias("key")).agg(F.first("words").alias("text")), "passage-words")
    heads = materialize(spark, heads.select("doc_id", "key", "same", F.col("seed").alias("n_words")), "passage-heads")
    release(spark, rows)
    hot, spans = hot_passages(spark, places, whole)
    matches = _pairs(places.where(F.col("n") <= PAIRED), ["seed"])
    found = materialize(
        spark,
        matches.repartition("key", "other").sortWithinPartitions("key", "other").mapInArrow(
            _chainer, "key long, other long, at array<int>, other_at array<int>"
        ),
        "passage-chains",
    )
    # Texts that repeat a word LEAST_WORDS times share all of those, wherever their ends are.
    long = places.where("long > 0")
    shared = long.groupBy("seed").agg((F.min("key") != F.max("key")).alias("_two")).where("_two").select("seed")
    long = materialize(spark, long.join(shared.hint("merge"), "seed").select("key", F.lit(None).cast("long").alias("other"), F.col("at").cast("long").alias("lo"), (F.col("at") + F.col("long")).cast("long").alias("hi")), "passage-repeats")
    release(spark, places)
    shape = "key long, other long, at array<int>, other_at array<int>"
    sides = materialize(spark, _by_text(spark, whole, found, "other").mapInArrow(_sides, f"{shape}, first int, words binary"), "passage-sides")
    passages = _by_text(spark, whole, sides, "key").mapInArrow(_aligner, "key long, other long, lo long, hi long")
    passages = materialize(spark, passages.unionByName(hot).unionByName(long).distinct(), "passages")
    release(spark, found, sides, hot, long, whole)
    return heads, passages, spans


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What each document shares with others.

    Null and empty texts share nothing; null doc_ids are allowed, and are never a class's id unless
    it has no other; rows that repeat doc_id and text are one document and returned each; other
    columns are ignored; an empty table gives an empty result.

    Returns doc_id, n_words, n_passages, n_shared (words in passages), n_links (documents that a
    passage was aligned with, or that have LEAST_WORDS equal words in common with it; each once), class_id (least doc_id that links reach), passages ("first-last"
    words from 0, in order, merged where they meet).
    """
    rows, passages, spans = shared_passages(spark, docs)
    classes = materialize(
        spark, rows.groupBy("same").agg(F.countDistinct("key").alias("size"), F.min("doc_id").alias("least"), F.first("n_words").alias("n")).withColumnRenamed("same", "key"), "passage-texts"
    )
    repeated = classes.where((F.col("size") > 1) & (F.col("n") >= LEAST_WORDS))  # share all their words
    passages = passages.unionByName(repeated.select("key", F.col("key").alias("other"), F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")))
    order = Window.partitionBy("key").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        passages.where("lo is not null").select("key", "lo", "hi").distinct()
        .withColumn("new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("new").over(order))
        .groupBy("key", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .groupBy("key").agg(
            F.count("*").alias("n_passages"),
            F.sum(F.col("hi") - F.col("lo")).alias("n_shared"),
            F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"),
        )
    )
    links = passages.where("other is not null").select("key", "other")
    both = links.unionByName(links.select(F.col("other").alias("key"), F.col("key").alias("other")))
    counts = materialize(spark, count_links(spark, spans, both, classes.select("key", "size"), LEAST_WORDS), "passage-counts")
    labels = components(spark, links.select(F.col("key").alias("a"), F.col("other").alias("b")), "passage-links")
    named = materialize(
        spark,
        runs.join(counts.hint("merge"), "key").join(classes.select("key", "least").hint("merge"), "key").join(labels.withColumnRenamed("node", "key").hint("merge"), "key", "left")
        .withColumn("component", F.coalesce("component", "key")),
        "passage-documents",
    )
    least = materialize(spark, named.groupBy("component").agg(F.min("least").alias("class_id")), "passage-classes")
    done = named.join(least.hint("merge"), "component")
    zero = F.lit(0).cast("long")
    text = F.transform("spans", lambda s: F.concat(s["lo"].cast("string"), F.lit("-"), (s["hi"] - 1).cast("string")))
    return rows.join(done.withColumnRenamed("key", "same").hint("merge"), "same", "left").select(
        "doc_id",
        "n_words",
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("n_passages", "n_shared", "n_links")],
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce(F.array_join(text, " "), F.lit("")).alias("passages"),
    )


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages that the documents share."""
    return report(spark, table(spark, sf_dir, "documents"))
