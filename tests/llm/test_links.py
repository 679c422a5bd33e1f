"""Links counted by sets of holders, against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from docquarry.llm import links, passages

WORDS = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ara", "elo", "imu", "ony", "usk")]


@pytest.mark.parametrize(("most", "listed"), [(1, 2), (3, 5), (8, 2), (8, 8)])
def test_counts_equal_all_pairs(spark, monkeypatch, most, listed):
    """Random spans on few hubs, with direct pairs and copies; texts of few and of many sets."""
    monkeypatch.setattr(links, "PARTS", most)
    monkeypatch.setattr(links, "LISTED", listed)
    rng = random.Random(most)
    spans = [(rng.randrange(4), rng.randrange(4, 60), lo, lo + rng.randrange(30, 90)) for lo in (rng.randrange(500) for _ in range(150))]
    spans += [(a, b, lo, lo + 40) for a, b in ((0, 1), (1, 2), (2, 0), (7, 0)) for lo in (0, 100)]
    spans += [(7, 10, lo, lo + 30) for lo in range(0, 600, 20)] + [(7, k, lo, lo + 30) for k in range(11, 40) for lo in rng.sample(range(0, 600, 20), 4)]
    pairs = {(a, b) for a in range(10, 70) for b in rng.sample(range(10, 70), 2)}
    pairs |= {(b, a) for a, b in pairs}
    sizes = {k: rng.randrange(1, 4) for k in range(70)}
    linked = set(pairs) | {(k, k) for s in spans for k in s[:2]} | {(a, b) for h, k, _, _ in spans for a, b in ((h, k), (k, h))}
    for h, k, lo, hi in spans:
        linked |= {(k, x) for g, x, a, b in spans if g == h and min(hi, b) - max(lo, a) >= 30}
    expected = {k: sum(sizes[x] for a, x in linked if a == k) - ((k, k) in linked) for k in {a for a, _ in linked}}
    pairs |= {(k, k) for s in spans for k in s[:2]}
    got = links.count_links(
        spark, spark.createDataFrame(spans, "hub long, key long, lo long, hi long"), spark.createDataFrame(sorted(pairs), "key long, other long"),
        spark.createDataFrame(list(sizes.items()), "key long, size long"), 30,
    ).collect()
    assert {r["key"]: r["n_links"] for r in got} == expected


def test_no_spans(spark):
    none = spark.createDataFrame([], "hub long, key long, lo long, hi long")
    pairs, sizes = spark.createDataFrame([(1, 2), (2, 1)], "key long, other long"), spark.createDataFrame([(1, 1), (2, 3)], "key long, size long")
    assert {tuple(r) for r in links.count_links(spark, none, pairs, sizes, 30).collect()} == {(1, 3), (2, 1)}


def test_any_number_of_holders(spark):
    """A passage of n texts gives n - 1 links to each, whatever n; one that holds two passages counts both, each document once."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(4000)) for _ in range(n))
    rows, expected = [], {}
    for at, n in ((0, 8), (1000, 9), (2000, 20), (3000, 500)):
        shared = text(40)
        rows += [(at + i, text(20) + " " + shared + " " + text(20)) for i in range(n)]
        expected |= {at + i: n - 1 for i in range(n)}
    first, second = text(45), text(45)
    for i in range(36):  # 0 to 11 hold both, 12 to 23 the first, 24 to 35 the second
        held = [p for p, has in ((first, i < 24), (second, i < 12 or i >= 24)) if has]
        rows.append((4000 + i, text(15) + " " + (" " + text(25) + " ").join(held) + " " + text(15)))
        expected[4000 + i] = 35 if i < 12 else 23
    rows += [(5000, rows[8][1])]  # a copy of a text among nine holders
    expected |= {1000 + i: 9 for i in range(9)} | {5000: 9}
    got = {r["doc_id"]: r["n_links"] for r in passages.report(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


@pytest.mark.parametrize("block", [1024, 16])
def test_commonest_seeds_lose_no_link(spark, monkeypatch, block):
    """Twelve words stand first in a hub, then in 40 texts whose words go on otherwise, but alike in pairs: the hub, and all runs of equal seeds, link none of these."""
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(5)
    text = lambda n: [rng.choice(WORDS) + str(rng.randrange(4000)) for _ in range(n)]
    head = next(h for h in (text(12) for _ in range(999)) if len(passages.seeds_of(passages.word_ids(" ".join(h).encode()))[0]) >= 2)
    tails = [t for t in (text(40) for _ in range(2000)) if not len(passages.seeds_of(passages.word_ids(" ".join(t[:30]).encode()))[0]) > 2][:20]
    rows = [(d, " ".join([*text(20), *head, *text(20)])) for d in range(20)]
    for k, tail in enumerate(tails):
        other = [w if i % 7 else "x" + w for i, w in enumerate(tail, 1)]
        rows += [(100 + 2 * k, " ".join([*text(20), *head, *tail])), (101 + 2 * k, " ".join([*text(20), *head, *other]))]
    got = {r["doc_id"]: r for r in passages.report(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d]["n_links"] == 0 for d in range(20))
    assert all(got[d]["n_links"] == 1 and got[d]["class_id"] == d // 2 * 2 for d in range(100, 100 + 2 * len(tails)))


def test_places_of_a_seed_against_all_pairs():
    """Lines that texts repeat, some edited: the links and stretches of all pairs of places, each but a few times."""
    rng = random.Random(9)
    seed = [7, 8, 9, 10, 11]
    lines = [[*seed, *[rng.randrange(20, 400) for _ in range(rng.randrange(2, 22))]] for _ in range(4)]
    rows, texts = [], {}
    for key in range(12):
        words = []
        for _ in range(25):
            words += [w if rng.random() > 0.04 else rng.randrange(400, 9000) for w in rng.choice(lines)]
        texts[key] = np.array(words, np.uint16)
        for at in (i for i in range(len(words)) if words[i : i + 5] == seed):
            first = max(0, at - passages.AROUND)
            rows.append((1, 0, 0, 0, len(rows), key, at, 0, True, at - first, texts[key][first : at + passages.K + passages.AROUND]))
    links_, spans = set(), set()
    for x in rows:
        for y in rows:
            if x[5] < y[5]:
                n, m = passages._equal_run(x[10][: x[9]][::-1], y[10][: y[9]][::-1]), passages._equal_run(x[10][x[9] :], y[10][y[9] :])
                whole = [(x[9] - n, x[9] + m, y[9] - n, y[9] + m)] if n + m >= 30 else passages.align(x[10], y[10], [(x[9], y[9])])
                for lo, hi, plo, phi in whole:
                    p, q = x[6] - x[9], y[6] - y[9]
                    links_ |= {(x[5], y[5]), (y[5], x[5])}
                    spans |= {(x[5], lo + p, hi + p), (y[5], plo + q, phi + q)}
    kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 2, *[pa.int32()] * 2, pa.bool_(), pa.int32(), pa.binary()]
    columns = [list(c) for c in zip(*rows, strict=True)]
    columns[10] = [w.tobytes() for w in columns[10]]
    batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list("abcdefghijk"))
    got = [r for found in passages._hot_passages(iter([batch])) for r in found.to_pylist()]
    assert len(links_) > 20 and len(spans) > 50
    assert {(r["key"], r["other"]) for r in got} == links_ and {(r["key"], r["lo"], r["hi"]) for r in got} == spans
    assert len(got) <= len(links_) + len(spans)


def test_repeated_words_are_few_places(spark):
    """Texts that repeat one word from 30 to 400 times: few seeds each, all linked, and each repeat shared as a whole."""
    for word in WORDS[:20]:
        assert len(passages.seeds_of(passages.word_ids(f"{word} ".encode() * 400))[0]) <= 1 + passages.RESYNC
    rng = random.Random(13)
    text = lambda n: [rng.choice(WORDS) + str(rng.randrange(4000)) for _ in range(n)]
    counts = [30, 400, *[rng.randrange(30, 200) for _ in range(22)]]
    rows = [(d, " ".join([*text(20), *["of"] * n, *text(20)])) for d, n in enumerate(counts)]
    rows += [(100, " ".join([*text(20), *["to"] * 90, *text(20)])), (101, " ".join([*text(20), *["of"] * 12, *text(20)]))]
    rows += [(200 + d, " ".join([*text(20), *["as"] * n, *text(20)])) for d, n in enumerate((31, 150))]
    got = {r["doc_id"]: r for r in passages.report(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((got[d]["n_links"], got[d]["class_id"], got[d]["passages"]) == (len(counts) - 1, 0, f"20-{19 + n}") for d, n in enumerate(counts))
    assert all((got[d]["n_links"], got[d]["passages"]) == (0, "") for d in (100, 101))
    assert [(got[d]["n_links"], got[d]["class_id"], got[d]["passages"]) for d in (200, 201)] == [(1, 200, "20-50"), (1, 200, "20-169")]


def test_found_links_and_stretches_by_themselves(monkeypatch):
    """What is handed on of the passages found: each two texts once, and a text's stretches that meet as one, whatever the batches."""
    rng = random.Random(17)
    rows = [(rng.randrange(6), rng.randrange(6, 12), lo, lo + rng.randrange(30, 60), 0) for lo in (rng.randrange(900) for _ in range(400))]
    rows += [(o, k, lo, hi, 0) for k, o, lo, hi, _ in rows]
    batches = [passages._found([tuple(np.array(c) for c in zip(*rows[at : at + 50], strict=True))], at == 0) for at in range(0, len(rows), 50)]
    for most in (1 << 15, 2):
        monkeypatch.setattr(passages, "PAIRS", most)
        monkeypatch.setattr(passages, "_hot_passages", lambda given: given)
        got = [r for b in passages._gathered(iter(batches)) for r in b.to_pylist()]
        assert [r for r in got if r["equal"]] == batches[0].to_pylist()
        links_ = [(r["key"], r["other"]) for r in got if not r["equal"] and r["other"] is not None]
        assert set(links_) == {(min(r[:2]), max(r[:2])) for r in rows[50:]}
        words = lambda spans: {(k, w) for k, lo, hi in spans for w in range(lo, hi)}
        runs = [(r["key"], r["lo"], r["hi"]) for r in got if r["other"] is None]
        assert words(runs) == words((r[0], r[2], r[3]) for r in rows[50:])
        if most > 2:
            assert len(links_) == len(set(links_)) and all(a[0] != b[0] or a[2] < b[1] for a, b in zip(sorted(runs), sorted(runs)[1:]))


def test_seeds_of_many_texts_at_once():
    """Texts chosen seeds of together have those that each has by itself, repeats and short or empty ones too; runs never go on into the next text."""
    rng = random.Random(21)
    texts = [" ".join(rng.choice([["of"] * n, [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(n)]])).encode() for n in [0, 3, 4, 5, 40, 0, *[rng.randrange(200) for _ in range(60)]]]
    starts, words = passages._words(b"\n".join(texts))
    bounds = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))
    at, seeds = passages.seeds_of(words, bounds)
    alone = [passages.seeds_of(passages.word_ids(t)) for t in texts]
    assert at.tolist() == [int(b + x) for b, (a, _) in zip(bounds, alone) for x in a]
    assert seeds.tolist() == [x for _, s in alone for x in s.tolist()]
    text = np.repeat(np.arange(len(texts)), [len(a) for a, _ in alone])
    runs = [passages.runs_of(np.zeros(len(a), int), a, s) for a, s in alone]
    assert passages.runs_of(text, at, seeds).tolist() == [x for r in runs for x in r.tolist()]
