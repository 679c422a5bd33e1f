"""Exact removal of byte strings that occur elsewhere, by bucket-pointer refinement.

The suffixes that take part are those at anchors: in each window of `length` bytes the leftmost
q-gram of least hash. Equal windows have their anchor at the same offset, so windows need comparing
only through their anchors. Suffixes fall into buckets by their q-grams; what is alone in its
bucket goes. A bucket is named by a pointer, its least member. Buckets are refined by grouping on
the pointers of the suffixes at later offsets: first by the string up to the next anchor, then by
(own pointer, pointer one anchor on), then by (own pointer, pointer two anchors on), each round
reusing what the last has found. Pointers of four anchors' length in a row then tell which anchors
have surroundings, all that any of their windows covers, that occur again: they are settled. Only
the anchors at the ends of repeats stay open, and their windows are compared byte for byte's worth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, release, row_key, slices, small_batches, table, trimmed, whole_groups

#: Bytes of an initial q-gram, and of a window.
Q, LENGTH = 32, 200
#: Odd multipliers of the two polynomial hashes modulo 2^64 that name strings.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes hashed at a time, beside the overlap; contexts compared at a time.
CHUNK, CONTEXTS = 1 << 17, 512


@lru_cache(maxsize=4)
def _powers(odd: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(odd))
    p[0] = 1
    return np.multiply.accumulate(p)


class Names:
    """Identifiers of strings of one stretch of bytes: mixed polynomial hashes from prefix sums."""

    def __init__(self, data: np.ndarray, base: int):
        room = CHUNK + 8 * LENGTH
        self.inverse = _powers(pow(base, -1, 1 << 64), room)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, room)[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.inverse[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Place:
    """A part of a text in a stretch: size bytes from place on, the text's from first on. The part
    answers for runs of windows that start at byte own to before end."""

    text: int
    first: int
    place: int
    size: int
    own: int
    end: int


def stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[Place]]]:
    """Bytes of about CHUNK at a time, and what they hold. Short texts share a stretch; a long one
    is taken in parts that overlap by all that a run of windows at their border needs."""
    parts: list[tuple[int, int, bytes, int, int]] = []
    size = 0

    def joined() -> tuple[np.ndarray, list[Place]]:
        places, at = [], 0
        for i, first, data, own, end in parts:
            places.append(Place(i, first, at, len(data), own, end))
            at += len(data)
        return np.frombuffer(b"".join(p[2] for p in parts), np.uint8), places

    for i, text in enumerate(texts):
        for own in range(0, max(0, len(text) - LENGTH + 1), CHUNK):
            first = max(0, own - LENGTH)
            part = text[first : own + CHUNK + 2 * LENGTH]
            if len(part) < LENGTH:
                continue
            if size + len(part) > CHUNK and parts:
                yield joined()
                parts, size = [], 0
            parts.append((i, first, part, own, own + CHUNK))
            size += len(part)
    if parts:
        yield joined()


def anchors_of(data: np.ndarray, places: list[Place]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, their anchors, the q-gram's identifier of every place) in a stretch.

    The anchor is the leftmost q-gram of least identifier (44 of its bits) in the window.
    """
    width = LENGTH - Q + 1
    n = len(data) - Q + 1
    at = np.arange(n)
    names = Names(data, BASES[0]).of(at, at + Q)
    keys = (names & ~np.uint64((1 << 20) - 1)) | at.astype(np.uint64)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = keys
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    starts = np.concatenate([np.arange(p.place, p.place + p.size - LENGTH + 1) for p in places])
    return starts, (least[starts] & np.uint64((1 << 20) - 1)).astype(np.int64), names


def _owners(places: list[Place], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the place, text, byte in it) of points in a stretch."""
    own = np.searchsorted([p.place for p in places], at, side="right") - 1
    text, shift = np.array([p.text for p in places]), np.array([p.first - p.place for p in places])
    return own, text[own], at + shift[own]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.as_py() or b"" for t in batch.column("text")]


def _key(batch: pa.RecordBatch, text: np.ndarray) -> dict[str, pa.Array]:
    at = pa.array(text)
    return {"_id": batch.column("_id").take(at), "_hash": batch.column("_hash").take(at)}


def anchor_rows(texts: list[bytes]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(text of each row, columns): the anchors of each text in order, and before them, where none
    stands there, the text's start, which has no windows (lo -1).

    name: of the q-gram. link: of the string from the anchor through the next anchor's q-gram, or
    to the end of the text. lo, hi: first and last window. The links from `back` anchors before on,
    `span` of them, cover all that these windows cover.
    """
    found = [[np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)]]
    for data, places in stretches(texts):
        starts, anchors, names = anchors_of(data, places)
        part, text, at = _owners(places, anchors)
        start = starts + (at - anchors)
        new = np.flatnonzero((np.diff(part) != 0) | (np.diff(anchors) != 0)) + 1
        first, last = np.concatenate(([0], new)), np.concatenate((new, [len(text)])) - 1
        lo = start[first]
        own = (np.array([p.own for p in places])[part[first]] <= lo) & (lo < np.array([p.end for p in places])[part[first]])
        first, last = first[own], last[own]
        found.append([text[first], at[first], start[first], start[last], names[anchors[first]]])
    text, at, lo, hi, name = (np.concatenate(c) for c in zip(*found, strict=True))
    heads = np.flatnonzero(np.diff(text, prepend=-1))
    heads = heads[at[heads] > 0]
    firsts = np.array([xxhash.xxh3_64_intdigest(texts[t][:Q], 2) for t in text[heads].tolist()], np.uint64)
    text = np.insert(text, heads, text[heads])
    at, lo, hi = (np.insert(c, heads, v) for c, v in ((at, 0), (lo, -1), (hi, -1)))
    name = np.insert(name, heads, firsts)

    n = len(text)
    head = np.flatnonzero(np.diff(text, prepend=-1))
    size = np.diff(np.append(head, n))
    base = np.concatenate(([0], np.cumsum([len(t) + LENGTH + Q for t in texts])))[text]
    place = base + at
    begin = np.searchsorted(place, base + lo, side="right") - 1
    end = np.searchsorted(place + Q, base + hi + LENGTH)
    last = np.repeat(head + size, size) - 1
    digest = xxhash.xxh3_64_intdigest
    after = np.append(at[1:], 0) + Q
    link = np.array(
        [digest(texts[t][a:], 1) if end_ else digest(texts[t][a:b]) for t, a, b, end_ in zip(text.tolist(), at.tolist(), after.tolist(), (last == np.arange(n)).tolist(), strict=True)],
        np.uint64,
    )
    windows = lo >= 0
    columns = {"i": np.arange(n) - np.repeat(head, size), "at": at, "lo": lo, "hi": hi}
    columns |= {"back": np.where(windows, np.arange(n) - begin, 0), "span": np.where(windows, end - begin, 0)}
    return text, {k: v.astype(np.int32) for k, v in columns.items()} | {"name": name.view(np.int64), "link": link.view(np.int64)}


ANCHORS = "i int, at int, lo int, hi int, back int, span int, name long, link long"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        text, columns = anchor_rows(_texts(batch))
        yield pa.record_batch(_key(batch, text) | {k: pa.array(v) for k, v in columns.items()})


#: Anchors that the pointers of the last round reach over, whose runs `_surroundings` names.
REACH = 4


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, anchor, level, pointer, back, span) sorted by the first three: level 0 has the
    anchors, others the pointers of so many links. A row for each anchor whose surroundings have
    pointers throughout: those of the largest level, as many as cover them."""
    for (text, anchor, level, pointer, back, span), _ in whole_groups(batches, 1):
        asked = np.flatnonzero(level == 0)
        begin, span, back = anchor[asked] - back[asked], span[asked], back[asked]
        keys: list[list[int] | None] = [None] * len(asked)
        for reach in (1, 2, REACH):
            own = np.flatnonzero(span >= reach if reach == REACH else (span >= reach) & (span < 2 * reach))
            rows = np.flatnonzero(level == reach)
            if not len(own) or not len(rows):
                continue
            known, values = anchor[rows], pointer[rows]  # anchors are numbered through all texts in the same order
            order = np.argsort(known, kind="stable")
            known, values = known[order], values[order]
            counts = -(-span[own] // reach)
            which = np.repeat(np.arange(len(own)), counts)
            step = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            want = begin[own][which] + np.minimum(step * reach, (span[own] - reach)[which])
            at = np.minimum(np.searchsorted(known, want), len(known) - 1)
            whole = np.ones(len(own), bool)
            np.logical_and.at(whole, which, known[at] == want)
            got, ends = values[at], np.cumsum(counts)
            for k in np.flatnonzero(whole).tolist():
                keys[own[k]] = got[ends[k] - counts[k] : ends[k]].tolist()
        kept = np.array([i for i, k in enumerate(keys) if k], np.int64)
        if len(kept):
            yield pa.record_batch(
                {
                    "anchor": pa.array(anchor[asked][kept]),
                    "back": pa.array(back[kept].astype(np.int32)),
                    "span": pa.array(span[kept].astype(np.int32)),
                    "pointers": pa.array([keys[i] for i in kept.tolist()], pa.list_(pa.int64())),
                }
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that the windows of open anchors cover."""
    for batch in slices(batches):
        texts = _texts(batch)
        owner, rows = [], []
        for i, runs in enumerate(batch.column("runs").to_pylist()):
            owner += [i] * len(runs)
            rows += [(r["name"], r["lo"], r["hi"], r["large"], texts[i][r["lo"] : r["hi"] + LENGTH]) for r in runs]
        if rows:
            name, lo, hi, large, data = zip(*rows, strict=True)
            columns = {"name": pa.array(name, pa.int64())} | _key(batch, np.array(owner))
            yield pa.record_batch(columns | {"lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64()), "large": pa.array(large, pa.bool_()), "data": pa.array(data, pa.binary())})


def window_names(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, window's place in it, two names) of all windows of some contexts."""
    sizes = np.array([len(c) for c in contexts])
    counts = sizes - LENGTH + 1
    own = np.repeat(np.arange(len(contexts)), counts)
    at = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(sizes) - sizes, counts) + at
    data = np.frombuffer(b"".join(contexts), np.uint8)
    one, two = (Names(data, base).of(start, start + LENGTH) for base in BASES)
    return own, at, one, two


def _pieces(contexts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(first, contexts) of about CHUNK bytes."""
    first, size = 0, 0
    for i, c in enumerate(contexts):
        if size + len(c) > CHUNK:
            yield first, contexts[first:i]
            first, size = i, 0
        size += len(c)
    if first < len(contexts):
        yield first, contexts[first:]


def _whole(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """(lo, hi) of whole groups, of about CONTEXTS rows together."""
    lo = 0
    for hi, after in zip(bounds[1:].tolist(), [*bounds[2:].tolist(), None], strict=True):
        if after is None or after - lo > CONTEXTS:
            yield lo, hi
            lo = hi


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that repeat among the anchors of one q-gram; rows come sorted by its name."""
    for columns, bounds in whole_groups(batches, 1):
        for a, b in _whole(bounds):
            _, id_, hash_, lo, _, data = (c[a:b] for c in columns)
            found = []
            for first, part in _pieces(data.tolist()):
                own, at, one, two = window_names(part)
                found.append((own + first, at, one, two))
            own, at, one, two = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((two, one))
            same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
            again = np.zeros(len(own), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            own, at = own[again], at[again]
            if len(own):
                new = np.flatnonzero((np.diff(own) != 0) | (np.diff(at) != 1)) + 1
                begin, end = np.concatenate(([0], new)), np.concatenate((new, [len(own)])) - 1
                o = own[begin]
                yield pa.record_batch({"_id": pa.array(id_[o]), "_hash": pa.array(hash_[o]), "lo": pa.array(lo[o] + at[begin]), "hi": pa.array(lo[o] + at[end])})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the contexts and its name, of 128 bits."""
    for batch in slices(batches):
        for first, part in _pieces([d.as_py() for d in batch.column("data")]):
            own, at, one, two = window_names(part)
            lo = batch.column("lo").to_numpy()[own + first] + at
            yield pa.record_batch(_key(batch, own + first) | {"lo": pa.array(lo), "one": pa.array(one.view(np.int64)), "two": pa.array(two.view(np.int64))})


def cut(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, maximal removed runs), where windows start in the runs."""
    kept, done, removed, spans = [], 0, 0, 0
    end = -1
    for lo, hi in sorted(runs):
        if lo > end:
            kept.append(text[max(done, 0) : lo])
            spans += 1
            removed += hi + LENGTH - lo
            end = done = hi + LENGTH
        elif hi + LENGTH > end:
            removed += hi + LENGTH - end
            end = done = hi + LENGTH
    kept.append(text[done:])
    return b"".join(kept), removed, spans


def keyed(docs: DataFrame, others: list[str] | None = None) -> DataFrame:
    """(_id, _hash, text, doc_id), and with others those columns as one struct, `rest`."""
    rest = [] if others is None else [F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest")]
    return docs.select(*row_key(), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), "doc_id", *rest)


KEY = "_id long, _hash long"


def refined(spark: SparkSession, members: DataFrame, name: str, *keys: str) -> DataFrame:
    """(text, anchor, pointer): the buckets of members (text, anchor, keys) that agree in all keys,
    named by their least anchor; what is alone in its bucket goes. The buckets are written first, so
    that the join with them can split a bucket of very many members."""
    buckets = members.groupBy(*keys).agg(F.min("anchor").alias("_least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    buckets = materialize(spark, buckets, f"{name}-buckets")
    found = materialize(spark, members.join(buckets, list(keys)).select("text", "anchor", F.col("_least").alias("pointer")), name)
    release(spark, buckets)
    return found


def repeated_runs(spark: SparkSession, texts: DataFrame, most: int = 4000) -> DataFrame:
    """(_id, _hash, runs) of the texts in which windows repeat; windows start at lo to hi of a run.

    The windows of anchors whose surroundings occur again all repeat. Those of other anchors whose
    q-gram occurs again are compared within its bucket, by names of 128 bits: in one task, or in a
    bucket of over `most` anchors by counting the names, which needs no bucket in one task. Of
    settled anchors with equal surroundings one stays as a witness, since windows of open anchors
    may equal some of its own. texts: as `keyed` gives them.
    """
    small_batches(spark)
    key = ["_id", "_hash"]
    every = materialize(spark, texts.select(*key, "text").mapInArrow(trimmed(_anchors), f"{KEY}, {ANCHORS}").withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    # The anchors of a text are numbered one after another, from the number that stands for the text.
    names = materialize(spark, every.groupBy("name").agg(F.count("*").alias("_n")).where("_n > 1").select("name"), "grams-repeated")
    shared = materialize(
        spark, every.join(names, "name").select((F.col("anchor") - F.col("i")).alias("text"), "anchor", "lo", "hi", "back", "span", "name", "link"), "anchors-repeated"
    )
    owners = materialize(spark, every.where("i = 0").select(F.col("anchor").alias("text"), *key), "anchor-texts")
    release(spark, every, names)
    levels = {1: refined(spark, shared.select("text", "anchor", "name", "link"), "pointers-1", "name", "link")}
    for reach in (1, 2):
        ahead = Window.partitionBy("text").orderBy("anchor").rangeBetween(reach, reach)
        later = levels[reach].withColumn("later", F.max("pointer").over(ahead)).where("later is not null")
        levels[2 * reach] = refined(spark, later, f"pointers-{2 * reach}", "pointer", "later")
    none = F.lit(0)
    rows = shared.where("lo >= 0").select("text", "anchor", none.alias("level"), none.cast("long").alias("pointer"), "back", "span")
    for reach, found in levels.items():
        rows = rows.unionByName(found.select("text", "anchor", F.lit(reach).alias("level"), "pointer", none.alias("back"), none.alias("span")))
    around = materialize(
        spark,
        rows.repartition("text").sortWithinPartitions("text", "anchor", "level").mapInArrow(trimmed(_surroundings), "anchor long, back int, span int, pointers array<long>"),
        "surroundings",
    )
    equal = ["pointers", "back", "span"]
    groups = materialize(spark, around.groupBy(*equal).agg(F.min("anchor").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "surroundings-repeated")
    settled = around.join(groups, equal).select("anchor", (F.col("anchor") == F.col("first")).alias("witness"))
    marked = materialize(
        spark, shared.where("lo >= 0").drop("link", "back", "span").join(settled, "anchor", "left").withColumn("settled", F.col("witness").isNotNull()), "anchors-marked"
    )

    release(spark, shared, around, groups, *levels.values())
    members = marked.where("not settled or witness")
    buckets = materialize(
        spark, members.groupBy("name").agg(F.count_if(~F.col("settled")).alias("_open"), F.count("*").alias("_n")).where("_open > 0 and _n > 1").select("name", (F.col("_n") > most).alias("large")), "buckets"
    )
    run = F.struct("name", "lo", "hi", "large")
    asked = materialize(spark, members.join(buckets, "name").join(owners, "text").groupBy(*key).agg(F.collect_set(run).alias("runs")), "asked")
    context = f"name long, {KEY}, lo long, hi long, large boolean, data binary"
    contexts = materialize(spark, texts.select(*key, "text").join(asked, key).mapInArrow(trimmed(_contexts), context), "contexts")
    in_one = contexts.where("not large").drop("large").repartition("name").sortWithinPartitions("name").mapInArrow(trimmed(_settle), f"{KEY}, lo long, hi long")
    windows = contexts.where("large").mapInArrow(trimmed(_windows), f"{KEY}, lo long, one long, two long")
    again = windows.groupBy("one", "two").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    counted = windows.join(again, ["one", "two"]).select(*key, "lo", F.col("lo").alias("hi"))
    known = marked.where("settled").join(owners, "text").select(*key, F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    runs = in_one.unionByName(counted).unionByName(known).groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    runs = materialize(spark, runs, "runs")
    release(spark, marked, buckets, asked, contexts, owners)
    return runs


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for text, runs in zip(_texts(batch), batch.column("runs").to_pylist(), strict=True):
            kept, removed, spans = cut(text, [(r["lo"], r["hi"]) for r in runs or ()])
            out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest()))
        n_bytes, removed, spans, digests = zip(*out, strict=True) if out else ([], [], [], [])
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
        )


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Remove each byte of every text that a LENGTH-byte string covers which also starts elsewhere.

    Nothing crosses texts, the same text counts, overlaps count, all is judged on the input. Null
    and empty texts, and those shorter than LENGTH, lose nothing. Null doc_ids are allowed, rows
    that repeat doc_id and text lose all (each is the other's copy), other columns are ignored, an
    empty table gives an empty result.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256.
    """
    texts = keyed(docs)
    runs = repeated_runs(spark, texts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        texts.join(runs, ["_id", "_hash"], "left")
        .select("doc_id", "text", "runs")
        .mapInArrow(trimmed(_cutter), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [
            cut(text, [(r["lo"], r["hi"]) for r in runs])[0].decode("utf-8", "ignore") if runs else text.decode()
            for text, runs in zip(_texts(batch), batch.column("runs").to_pylist(), strict=True)
        ]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, pa.field("text", pa.string()), pa.array(kept, pa.string())).drop_columns(["runs"])


def keep_rest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All documents with what `remove_repeats` leaves of their texts, and n_chars to match.

    A character that is cut apart goes whole; a null text becomes empty. Other columns stay as they
    are, whatever they are called.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    texts = keyed(docs, others)
    whole = texts.join(repeated_runs(spark, texts), ["_id", "_hash"], "left").select("rest", "text", "runs")
    out = whole.mapInArrow(trimmed(_rest), f"rest {whole.schema['rest'].dataType.simpleString()}, text string")
    columns = {c: F.col("rest").getField(c) for c in others} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated byte strings of all documents."""
    return remove_repeats(spark, table(spark, sf_dir, "documents"))
