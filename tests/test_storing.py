"""Shards, pages and closures against plain Python."""

from __future__ import annotations

import collections
import os
import random

import pytest

from docquarry.operators import graph, ordering, shards
from docquarry.pagestore import PageStore


def fill(rows, most_bytes, most_rows):
    out, unit, b, r = [], -1, 0, 0
    for size, weight in rows:
        if unit < 0 or b + size > most_bytes or r + weight > most_rows:
            unit, b, r = unit + 1, 0, 0
        b, r = b + size, r + weight
        out.append(unit)
    return out


@pytest.mark.parametrize("kind", ["mixed", "equal", "large"])
def test_filled(spark, kind):
    rng = random.Random(kind)
    size = {"mixed": lambda: rng.choice((0, 1, 7, rng.randrange(60), 500)), "equal": lambda: 10, "large": lambda: 300}[kind]
    rows = [(i, size(), rng.randrange(1, 4)) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, size long, weight long").repartition(7)
    got = shards.filled(df, ["k"], "size", "weight", 100, 25).orderBy("k").collect()
    assert [r["unit"] for r in got] == fill([r[1:] for r in rows], 100, 25)
    assert shards.filled(df.where("k < 0"), ["k"], "size", "weight", 100, 25).count() == 0


def test_filled_in_many_ranges(spark):
    """Units that span ranges, and ranges that no unit begins in."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(6)
        rows = [(i, rng.randrange(30), 1) for i in range(400)]
        df = spark.createDataFrame(rows, "k long, size long, weight long")
        for most in (20, 700):
            got = shards.filled(df, ["k"], "size", "weight", most, 10**6).orderBy("k").collect()
            assert [r["unit"] for r in got] == fill([r[1:] for r in rows], most, 10**6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_assign(ledger, candidates, existing, most_bytes, most_rows):
    """The same one document after another."""
    state = {i: [b, r, d, o] for i, b, r, d, o in ledger}
    dealt = dict(existing)
    now = max((i for i, s in state.items() if s[3]), default=None)
    for key, size, weight in sorted(candidates):
        if key in existing:
            continue
        size, weight = max(0, size), max(1, weight)
        if now is not None and state[now][2] and (state[now][0] + size > most_bytes or state[now][1] + weight > most_rows):
            state[now][3], now = False, None
        if now is None:
            now = max(state, default=0) + 1
            state[now] = [0, 0, 0, True]
        s = state[now]
        s[0], s[1], s[2] = s[0] + size, s[1] + weight, s[2] + 1
        dealt[key] = now
        if s[0] > most_bytes or s[1] > most_rows:
            s[3], now = False, None
    return dealt, {i: tuple(s) for i, s in state.items()}


LEDGERS = {
    "empty": [], "open": [(1, 95, 9, 4, False), (2, 40, 5, 3, True)], "sealed": [(1, 95, 9, 4, False), (2, 140, 5, 3, False)], "fresh": [(1, 95, 9, 4, False), (2, 0, 0, 0, True)],
    "full": [(1, 99, 9, 3, True)], "over": [(3, 400, 2, 1, True)],
}


@pytest.mark.parametrize("name,n", [*[(name, 60) for name in sorted(LEDGERS)], ("open", 0), ("open", 1)])
def test_assign(spark, name, n):
    rng = random.Random(n)
    existing = {f"old{i}": 1 for i in range(3)} if name != "empty" else {}
    candidates = [(f"k{rng.randrange(10**6):06}", rng.choice((-5, 0, 3, 20, 130)), rng.choice((0, 1, 2, 30))) for _ in range(n)] + [(k, 50, 1) for k in existing]
    frames = (
        spark.createDataFrame(LEDGERS[name], shards.LEDGER),
        spark.createDataFrame(candidates, "key string, text_bytes long, row_count long"), spark.createDataFrame(list(existing.items()), "key string, shard_index long"),
    )
    dealt, ledger = shards.assign(spark, *frames, 100, 10)
    want, state = plain_assign(LEDGERS[name], candidates, existing, 100, 10)
    assert {r["key"]: r["shard_index"] for r in dealt.collect()} == want
    assert {r["shard_index"]: tuple(r)[1:] for r in ledger.collect()} == state
    if name != "open":
        return
    again, same = shards.assign(spark, ledger, frames[1], dealt, 100, 10)
    assert sorted(again.collect()) == sorted(dealt.collect()) and sorted(same.collect()) == sorted(ledger.collect())


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice((None, *range(50))), i, rng.randrange(9)) for i in range(500)]
    got = ordering.running(spark.createDataFrame(rows, "a long, b long, v long"), ["a", "b"], ["v"]).orderBy("pos").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["a"], r["b"], r["v"]) for r in got] == order and [r["pos"] for r in got] == list(range(500))
    assert [r["v_before"] for r in got] == [sum(x[2] for x in order[:i]) for i in range(500)]


PAGES = "file_hash string, extracted_by string, page_id int, text string"


def stored(store):
    return sorted((r["file_hash"], r["extracted_by"], r["page_id"], r["text"], r["text_bytes"]) for r in store.pages().collect())


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_page_store(spark, tmp_path):
    store = PageStore(spark, str(tmp_path / "s"), 4)
    assert store.pages().count() == 0 and store.compact() == []
    first = [(f"f{i}", e, p, f" page {p} of {i} é ") for i in range(12) for e in ("raw", "ocr") for p in range(1, 4)] + [("f1", "raw", 4, " x "), ("f2", "raw", 4, None), ("f3", "raw", 2, "zz greater")]
    assert store.put(spark.createDataFrame(first, PAGES)) == 24
    want = {(f, e, p): t.strip() for f, e, p, t in first if t and len(t.strip()) >= 2}
    as_rows = lambda d: sorted((*k, t, len(t.encode())) for k, t in d.items())
    assert stored(store) == as_rows(want)
    # f0/raw shrinks to two pages, of which one is blank now; f5/ocr grows; f7/raw is as it was.
    second = [("f0", "raw", 1, "new"), ("f0", "raw", 2, "  "), *[("f5", "ocr", p, f"page {p} again") for p in range(1, 6)], *[r for r in first if r[:2] == ("f7", "raw")]]
    assert store.put(spark.createDataFrame(second, PAGES)) == 2
    want = {k: t for k, t in want.items() if k[:2] not in {("f0", "raw"), ("f5", "ocr")}} | {("f0", "raw", 1): "new"} | {("f5", "ocr", p): f"page {p} again" for p in range(1, 6)}
    assert stored(store) == as_rows(want)
    assert store.put(spark.createDataFrame(second, PAGES)) == 0 and len(store._parts("pages", False)) == 2
    before = files_of(store.path + "/pages")
    rewritten = store.compact()
    after = files_of(store.path + "/pages")
    assert rewritten and len(rewritten) < 4 and stored(store) == as_rows(want) and store.compact() == []
    untouched = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in rewritten}
    assert untouched and untouched <= set(after) and all(before[f] == after[f] for f in untouched)
    assert not [f for f in after if f in before and f not in untouched]
    last = store.heads().where("file_hash = 'f1' and extracted_by = 'raw'").first()
    assert last["last_page"] == 4
    with pytest.raises(ValueError):
        store.put(spark.createDataFrame([("f", "raw", 0, "text")], PAGES))


def test_a_put_that_was_not_finished_does_not_count(spark, tmp_path):
    store = PageStore(spark, str(tmp_path / "s"), 2)
    store.put(spark.createDataFrame([("f", "raw", 1, "one"), ("g", "raw", 1, "two")], PAGES))
    store.put(spark.createDataFrame([("f", "raw", 1, "later")], PAGES))
    os.remove(f"{store.path}/heads/gen=1/_SUCCESS")
    assert [r[3] for r in stored(store)] == ["one", "two"]
    store.put(spark.createDataFrame([("f", "raw", 1, "last")], PAGES))
    assert [r[3] for r in stored(store)] == ["last", "two"]


def slow_ancestors(edges, depth, most):
    up = collections.defaultdict(set)
    for n, p in edges:
        if n != p:
            up[n].add(p)
    out = {}
    for n in list(up):
        seen, level, hops, cut = {n: 0}, {n}, 0, False
        while level and hops < depth and len(seen) - 1 <= most:
            hops += 1
            level = {p for x in level for p in up.get(x, ())} - set(seen)
            seen |= dict.fromkeys(level, hops)
        beyond = {p for x in level for p in up.get(x, ())} - set(seen)
        ranked = sorted((h, a) for a, h in seen.items() if a != n)
        cut = len(ranked) > most or (bool(beyond) and hops == depth)
        out |= {(n, a): (h, cut) for h, a in ranked[:most]}
    return out


def closed(spark, edges, **more):
    return {(r["node"], r["ancestor"]): (r["hops"], r["truncated"]) for r in graph.ancestors(spark.createDataFrame(edges, "node long, parent long"), **more).collect()}


def test_a_chain_of_diamonds(spark):
    edges = [e for i in range(0, 66, 3) for e in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3))]
    got = closed(spark, edges)
    assert len(got) == 2189 and got == slow_ancestors(edges, 64, 4096)


@pytest.mark.parametrize("depth,most", [(64, 4096), (3, 4096), (64, 5), (2, 3), (64, 1)])
def test_caps_of_a_closure(spark, depth, most):
    rng = random.Random(depth + most)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)] + [(1, 2), (2, 1), (50, 51), (51, 52), (52, 53), (53, 54), (7, 7)]
    got = closed(spark, edges, depth=depth, most=most)
    assert got == slow_ancestors(edges, depth, most)
    assert any(cut for _, cut in got.values()) == (depth < 64 or most < 4096)


def test_ego_counts_all_within_reach(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 31)] + [(1, 100), (100, 101)], "src long, dst long")
    assert tuple(graph.ego_flags(edges, 0, 2, 5).first()) == (5, True, True)
    assert tuple(graph.ego_flags(edges, 0, 3, 50).first()) == (33, False, False)
    assert [r["node"] for r in graph.ego(edges, 0, 2, 5).collect()] == [0, 1, 2, 3, 4]


def test_newest_pages_are_read_without_a_join(spark, tmp_path):
    """After compaction no text is joined or shuffled to read the pages; pages replaced by nothing go."""
    from docquarry.pagestore import PageStore

    store = PageStore(spark, f"{tmp_path}/pages", 2)
    rows = [(f"f{i}", "text", 1, f"text {i}") for i in range(40)]
    columns = "file_hash string, extracted_by string, page_id int, text string"
    store.put(spark.createDataFrame(rows, columns))
    store.put(spark.createDataFrame([(f"f{i}", "text", 1, "") for i in range(0, 40, 4)], columns))
    kept = {f"text {i}" for i in range(40) if i % 4}
    assert {r["text"] for r in store.pages().collect()} == kept
    store.put(spark.createDataFrame([("f1", "text", 1, "other"), ("f0", "text", 1, "back")], columns))
    store.compact()
    assert {r["text"] for r in store.pages().collect()} == kept - {"text 1"} | {"other", "back"}
