"""Spelling variants, codebooks and decontamination against brute force, on small tables with all the odd cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from docquarry.llm import codebooks, common, decontaminate, spelling

DOCS = "doc_id long, text string, lang string, word string, n long, h string, `row` long, item string, key string, window string"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return common.materialize(spark, spark.createDataFrame([(d, t, "en", "w", 7, "h", 3, "i", "k", "x") for d, t in rows], DOCS), "test-docs")


# Spelling


def slow_variants(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    words = {w: c for w, c in n.items() if c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, count = {}, {}
    for w in words:
        close = [v for v in words if near(w, v)]
        count[w] = len(close)
        best = min(close, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], count[w], words.get(form[w])) for w in words}


def spelled(spark, rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(spark, frame(spark, rows)).collect()}


def test_spelling_by_brute_force(spark):
    rng = random.Random(3)
    bases = ["".join(rng.choice("abcdeÉéü÷") for _ in range(rng.randrange(4, 9))) for _ in range(40)]

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice((w, w, w.upper(), w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcü") + w[i + 1 :]))

    rows = [(d, " 1-".join(typo(rng.choice(bases)) for _ in range(120))) for d in range(40)]
    rows += [(None, "Häuser häuser HÄUSER Hauser"), (None, None), (7, ""), (8, "  \n "), (9, rows[0][1]), (9, rows[0][1]), (10, "İstanbul Kelvin ǅungla ſeven" * 3)]
    got, want = spelled(spark, rows), slow_variants(rows)
    assert len(want) > 100 and any(v[0] for v in want.values())
    assert got == want


def test_spelling_ties_chains_and_empty(spark):
    rows = [(1, "abcde " * 3 + "abcdx " * 6 + "abcdy " * 6 + "abcdxz " * 12 + "abcdxzz " * 24)]
    got = spelled(spark, rows)
    assert got == slow_variants(rows)
    assert got["abcde"][:2] == ("abcdx", "abcdxzz")  # of equal ones the least; then on along the forms
    assert spelling.variants(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_spelling_of_very_long_words_and_texts(spark):
    long = "ab" * 30_000
    rows = [(1, f"{long} {long} {long} {long}x " + "words " * 300_000), (2, f"{long}x {long}x {long}x " * 4)]
    got = spelled(spark, rows)
    assert got == slow_variants(rows) and got[long][0] == long + "x"


def test_blocks_that_are_split(spark, monkeypatch):
    """All permutations of a few letters share a block of one key; blocks of three words."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 3)
    rng = random.Random(1)
    words = {"".join(rng.sample("abcdxyz", 6)) for _ in range(150)} | {"bcdfg" + c for c in "hjkpqvxyz"}
    rows = [(i, f"{w} {w} {w}") for i, w in enumerate(sorted(words))]
    assert spelled(spark, rows) == slow_variants(rows)


def test_gram_distances_never_miss_an_edit():
    rng = random.Random(9)
    for _ in range(300):
        w = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéèüßñÿ") for _ in range(rng.randrange(5, 12)))
        i = rng.randrange(len(w))
        c = rng.choice([x for x in "abcéèüßñÿz" if x != w[i]])
        for v in (w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]):
            a, b = spelling._letters([w]), spelling._letters([v])
            i_, j_ = spelling.near_pairs(a, b, False)
            assert list(i_) == [0] and list(j_) == [0]


# Codebooks

VECTORS = "vec_id long, embedding array<float>, label int, `row` long, part int, code string"


def slow_codes(rows, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0], [float(np.float32(x)) for x in r[1]]))
    whole = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] for r in kept]
    w = len(whole[0]) // 8
    parts = [[tuple(v[p * w : p * w + w]) for v in whole] for p in range(8)]
    books = [list(p[:16]) for p in parts]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            by = collections.defaultdict(list)
            for v in parts[p]:
                by[nearest(v, books[p])[1]].append(v)
            for k, vs in by.items():
                books[p][k] = tuple(sum(c) // len(vs) for c in zip(*vs, strict=True))
    out = []
    for i, r in enumerate(kept):
        found = [nearest(parts[p][i], books[p]) for p in range(8)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), r[2]))
    sums = collections.Counter()
    for o in out:
        sums[o[3]] += o[2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(v), c, e, sums[label], digest) for v, c, e, label in out)


def vectors(rng, n, dim=16):
    return [(i, [rng.choice((-1.5, 0.0, 0.25, rng.gauss(0, 1))) for _ in range(dim)], rng.choice((0, 1, None))) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("block", [5, 256])
def test_codes_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(codebooks, "BLOCK", block)
    rng = random.Random(8)
    rows = vectors(rng, 150)
    rows += [(5, None, 1), (6, [float("nan")] * 16, 1), (7, [float("inf")] * 16, 1), (8, [None] * 16, 1), (None, [0.5] * 16, 2), *[(9000 + i, [0.125] * 16, 3) for i in range(90)], rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], VECTORS)
    got = codebooks.compress(spark, df).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == slow_codes(rows)


def test_codes_of_few_none_and_other_lengths(spark):
    rng = random.Random(2)
    few = vectors(rng, 9, 8)
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in few], VECTORS)
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codebooks.compress(spark, df).collect()) == slow_codes(few)
    assert codebooks.compress(spark, spark.createDataFrame([], VECTORS)).count() == 0
    odd = codebooks.compress(spark, spark.createDataFrame([(*r, 1, 2, "c") for r in [*few, (1, [1.0] * 7, 0), (2, [], None)]], VECTORS)).collect()
    assert sorted(str(r["vec_id"]) for r in odd if r["code"] is None and r["error"] is None and r["label_error"] is None) == ["1", "2"] and len(odd) == 11
    huge = codebooks.compress(spark, spark.createDataFrame([(1, [3e38, -3e38] * 4, 0, 1, 2, "c"), (2, [0.0] * 8, 0, 1, 2, "c")], VECTORS)).collect()
    assert all(r["error"] == 0 for r in huge) and len(huge) == 2


def test_hilbert_places_are_a_walk():
    """Points in the order of their places are all different and each one step from the last."""
    for dims, bits in ((2, 4), (3, 3), (8, 1)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = codebooks.hilbert_index(grid, bits)
        walk = grid[np.argsort(place)]
        assert sorted(place.tolist()) == list(range(len(grid))) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shortlists_keep_the_nearest():
    rng = np.random.default_rng(4)
    shorter = 0
    for _ in range(200):
        v = rng.integers(-20, 20, (1, 4)) + rng.integers(-3, 4, (6, 4))
        entries = rng.integers(-25, 25, (16, 4))
        some = codebooks.shortlist(v.min(0), v.max(0), entries)
        shorter += len(some) < 16
        assert set(codebooks.nearest_entry(v, entries)[0]) <= set(some.tolist())
    assert shorter > 100


# Decontamination


def slow_contamination(docs, items, window=10):
    split = lambda t: [w for w in re.split("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    windows = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((str(doc), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def checked(spark, docs, items, **more):
    bench = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, n long, window string")
    got = decontaminate.contamination(spark, frame(spark, docs), bench, **more).collect()
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got)


def leaky():
    rng = random.Random(12)
    words = "the of and a in to it is was für été 日本 x1 2 stone river".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice((1, 2, 3, 4, 5, 6, 9, 10, 11, 14, 30)))) for i in range(25)]
    items += [(3, items[20][1]), (100, items[20][1].upper()), (None, text(12)), (None, "only once here"), (101, ""), (102, None), (103, " .,; "), (11, text(12)), (12, text(12))]
    docs = []
    for d in range(60):
        at = rng.choice(items)[1] or ""
        docs.append((d, f"{text(rng.randrange(30))}, {at.replace(' ', rng.choice((' ', '--', ' \n')))} {text(rng.randrange(30))}"))
    docs += [(None, items[5][1]), (None, None), (61, ""), (62, items[24][1]), (62, items[24][1]), (63, " ".join([items[20][1]] * 400) + text(20_000)), (64, "Only ONCE here"), (65, "only once"), (66, "İ Only\x00once here")]
    return docs, items


def test_contamination_by_brute_force(spark):
    docs, items = leaky()
    want = slow_contamination(docs, items)
    assert checked(spark, docs, items) == want and 5 < sum(r[5] for r in want) < len(want)


@pytest.mark.parametrize("window,shingle", [(3, 2), (6, 5), (1, 1)])
def test_contamination_of_other_windows(spark, window, shingle):
    docs, items = leaky()
    assert checked(spark, docs, items, window=window, shingle=shingle) == slow_contamination(docs, items, window)


def test_contamination_of_nothing(spark):
    docs, _ = leaky()
    assert checked(spark, docs[:5], []) == slow_contamination(docs[:5], []) == checked(spark, docs[:5], [(1, None), (2, "?")])
    assert checked(spark, [], [(1, "some text")]) == []


def test_a_full_gate_changes_nothing(spark, monkeypatch):
    """Positions that the gate lets through wrongly fall out of the join."""
    docs, items = leaky()
    monkeypatch.setattr(decontaminate.Gate, "passes", lambda self, h: np.arange(len(h)))
    docs = docs[:12]
    rows = decontaminate._prober(decontaminate.Gate(16, []), [5], 10)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([docs[0][1]])], ["row", "doc_id", "text"])
    assert sum(b.num_rows for b in rows(iter([batch]))) == 1 + max(0, len(decontaminate.split_words(docs[0][1])) - 4)


def test_gate_holds_what_it_was_given(spark):
    rng = random.Random(5)
    hashes = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    gate = decontaminate.Gate.of(spark.createDataFrame([(h,) for h in hashes], "h long"))
    asked = np.array(hashes, np.int64).view(np.uint64)
    assert len(gate.passes(asked)) == len(asked)
    other = np.array([rng.randrange(1 << 64) for _ in range(20_000)], np.uint64)
    assert len(gate.passes(other)) < 1000
