"""The corpus operators against brute force, on small tables with all the odd cases."""

from __future__ import annotations

import collections
import dataclasses
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece as spm
import xxhash

from docquarry.llm import ann, common, components, fingerprints, licenses, mixing, passages, sentencepiece, sharding, simhash, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, `group` string, _id string, _hash int, runs string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega é ü 日本".split()


def make_docs():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))
    base, shared = text(120), text(60)
    near = base.replace(base.split()[50], "other", 1)
    long_text = text(60_000)
    texts = {
        1: base, 2: base, 3: near, 4: text(40) + "\n" + shared + "\n" + text(30), 5: shared + " " + text(50), 6: "", 7: None, 8: "x", 9: "MIT License\nmit LICENSE, Apache License!", 10: long_text,
        11: long_text[5000:9000] + text(20), 12: "a" * 1000, 13: "b" * 450, 14: "   \n\n ", 15: "General\tPublic   License and İ K Apache Licİense", 16: text(30),
    }
    rows = [(d, t, "en", None if d == 16 else "src1" if d % 3 else "src0", len(t or ""), d, "g", "z", 1, "r") for d, t in texts.items()]
    rows += [(None, text(25), "en", "src0", 1, 1, "g", "z", 1, "r"), (None, None, None, None, None, 1, "g", "z", 1, "r"), rows[15], rows[15]]
    return rows


ROWS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return common.materialize(spark, spark.createDataFrame(ROWS, SCHEMA), "test-docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs():
    return [(r[0], r[1] or "") for r in ROWS]


def as_key(d):
    return (-1 if d is None else d,)


def test_shards(spark, docs, none):
    rows = sharding.shard_by_bytes(spark, docs, 5).collect()
    assert sharding.shard_by_bytes(spark, none, 5).count() == 0
    want = sorted((as_key(d)[0], len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in pairs())
    assert sorted((as_key(r["doc_id"])[0], r["size"], r["text_crc32"]) for r in rows) == want
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in g) == list(range(len(g))) for g in by.values())
    assert all(abs(sum(r["size"] for r in g) - total / 5) <= most for g in by.values())
    order = [as_key(r["doc_id"]) for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


@pytest.mark.parametrize("weights", [None, {"src0": 5.0, "src1": 1.0}])
def test_mixing(spark, docs, none, weights):
    rows = mixing.mix_sources(spark, docs, weights, block_rows=2).collect()
    assert mixing.mix_sources(spark, none).count() == 0 and len(rows) == len(ROWS)
    blocks = {(r["source"], r["block"]): (r["release"], r["turn"], r["deadline"], r["slot"]) for r in rows}
    assert sorted(b[3] for b in blocks.values()) == list(range(len(blocks)))
    assert all(r <= t < d for r, t, d, _ in blocks.values())
    assert sorted(blocks, key=lambda b: blocks[b][1]) == sorted(blocks, key=lambda b: blocks[b][3])
    assert max(collections.Counter((r["source"], r["block"]) for r in rows).values()) == 2
    ordered = mixing.mixed_order(spark, docs, weights, 2)
    assert ordered.columns == docs.columns and sorted(map(repr, ordered.collect())) == sorted(map(repr, docs.collect()))


def test_mixing_query_schedules_several_classes(spark, tmp_path):
    """Sources of 4, 64 and 1024 rows and without a name weigh 2, 8, 32 and 4, and their turns show it."""
    sizes = {"a": 4, "b": 64, "c": 1024, None: 16}
    rows = [(1000 * k + i, f"{s} {i}", s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r["source"]: r["weight"] for r in mixing.tempered_weights(docs).collect()} == {"a": 2.0, "b": 8.0, "c": 32.0, mixing.NO_SOURCE: 4.0}
    got = mixing.op9_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    share = {"a": (2, 46), "b": (8, 46), "c": (32, 46), None: (4, 46)}
    for r in got:
        q, length = share[r["source"]]
        assert r["release"] == r["block"] * length // q and r["deadline"] == -((r["block"] + 1) * length // -q) and r["release"] <= r["turn"] < r["deadline"]


def test_mixing_keeps_within_one_block(spark):
    """Against the exact shares, over all turns; a weight of 0.0004 too."""
    weights = {"a": 0.5, "b": 0.25, "c": 0.2496, "d": 0.0004}
    rows = [(i, f"{s}{i}", s) for s, n in (("a", 5200), ("b", 2600), ("c", 2600), ("d", 4)) for i in range(n)]
    got = mixing.mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, block_rows=1).collect()
    order = {r["turn"]: r["source"] for r in got}
    done = collections.Counter()
    for t in range(10_000):
        done[order[t]] += 1
        assert all(abs(done[s] - w * (t + 1)) < 1 for s, w in weights.items())


def slow_edf(shares):
    length, done, out = sum(shares), [0] * len(shares), []
    for t in range(length):
        ready = [(-(-(k + 1) * length // q), i) for i, (k, q) in enumerate(zip(done, shares)) if k * length // q <= t]
        _, i = min(ready)
        out.append((i, done[i], t))
        done[i] += 1
    return out


def test_edf_by_brute_force(spark):
    rng = random.Random(6)
    for shares in ([1], [5, 3, 1, 1], [rng.randrange(1, 90) for _ in range(9)]):
        assert sorted((r["class"], r["r"], r["at"]) for r in mixing.edf_cycle(spark, shares).collect()) == sorted(slow_edf(shares))
    assert mixing.exact_shares([0.1, 0.3], [1, 1]) == [1, 3] and sum(mixing.exact_shares([1 / 3, 0.12345678901], [1, 2])) <= mixing.MOST_CYCLE + 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    assert components.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def slow_simhash(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, none):
    got = simhash.near_groups(spark, docs).collect()
    assert simhash.near_groups(spark, none).count() == 0 and len(got) == len(ROWS)
    fps = [(d, slow_simhash(t)) for d, t in pairs()]
    assert sorted((as_key(r["doc_id"])[0], r["fp"] % 2**64) for r in got) == sorted((as_key(d)[0], f) for d, f in fps)
    group = {f: {f} for _, f in fps}
    for a in list(group):
        for b in list(group):
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    least = {f: min((d for d, g in fps if g in group[f] and d is not None), default=None) for _, f in fps}
    assert all(r["component_id"] == least[r["fp"] % 2**64] for r in got)
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len({frozenset(g) for g in group.values()})
    assert all(r["_id"] == "z" and r["_hash"] == 1 for r in kept.collect())


def test_dense_buckets_link_without_pairs():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    fps = np.unique(np.array([int(centre) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (3000, 2))], dtype=np.uint64))
    links = simhash.link_bucket(fps, 3)
    assert len(links) < len(fps) and all((int(fps[a]) ^ int(fps[b])).bit_count() <= 3 for a, b in links)
    groups = list(range(len(fps)))
    for a, b in links:
        old, new = groups[a], groups[b]
        groups = [new if g == old else g for g in groups]
    assert len(set(groups)) == 1


def slow_cut(texts, whole=False):
    seen = collections.Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    out = []
    for b in texts:
        mark, done = bytearray(len(b)), 0
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                for j in range(max(i, done), i + 200):
                    mark[j] = 1
                done = i + 200
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append(kept if whole else (len(b), sum(mark), sum(m and (not i or not mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(spark, docs, none):
    got = suffixes.remove_repeats(spark, docs).collect()
    assert suffixes.remove_repeats(spark, none).count() == 0
    want = slow_cut([t.encode() for _, t in pairs()])
    assert sorted((as_key(r["doc_id"]), *r[1:]) for r in got) == sorted((as_key(d), *w) for (d, _), w in zip(pairs(), want))
    texts = {(r["_id"], r["_hash"]): bytes(r["text"]) for r in suffixes.keyed(docs).collect()}
    by_count, in_buckets = (suffixes.repeated_runs(spark, suffixes.keyed(docs), most).collect() for most in (1, 20_000))
    kept = lambda found: {(r["_id"], r["_hash"]): suffixes.cut(texts[r["_id"], r["_hash"]], [tuple(x) for x in r["runs"]]) for r in found}
    assert kept(by_count) == kept(in_buckets)
    rest = suffixes.keep_rest(spark, docs)
    assert rest.columns == docs.columns and rest.count() == len(ROWS)
    for r in rest.collect():
        assert r["n_chars"] == len(r["text"]) and (r["_id"], r["_hash"], r["runs"]) == ("z", 1, "r")


def test_repeats_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    rng = random.Random(2)
    a, b = (bytes(rng.choice(b"abcdefgh ") for _ in range(9000)) for _ in range(2))
    texts = [a, b[:2500] + a[1500:7000] + b[2500:], b"c" * 3000, b[:260]]
    found = collections.Counter()
    for data, places in suffixes.stretches(texts):
        starts, anchors, _ = suffixes.anchors_of(data, places)
        _, text, start = suffixes._owners(places, starts)
        _, _, at = suffixes._owners(places, anchors)
        for i, (t, s, x) in enumerate(zip(text.tolist(), start.tolist(), at.tolist())):
            found[texts[t][s : s + 200], x - s] += 1
    offsets = collections.defaultdict(set)
    for (window, offset), _ in found.items():
        offsets[window].add(offset)
    assert all(len(o) == 1 for o in offsets.values())
    assert set(offsets) == {t[i : i + 200] for t in texts for i in range(len(t) - 199)}


def test_fingerprints(spark, docs, none):
    got = fingerprints.fingerprint_documents(spark, docs).collect()
    assert fingerprints.fingerprint_documents(spark, none).count() == 0 and len(got) == len(ROWS)
    pattern = re.compile(r"[ \t\n\r\f\v]*+[^ \t\n\r\f\v]++(?:[ \t\r\f\v]++[^ \t\n\r\f\v]++){0,23}|[ \t\n\r\f\v]++")
    parts = lambda t: set(collections.Counter(m[0] for m in pattern.finditer(t)).items())
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    known = sorted({(d, t) for d, t in pairs() if d is not None}, key=lambda p: -p[0])
    rows = {r["doc_id"]: r for r in got}
    for (d, t), (_, after) in zip(known, known[1:]):
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        r = rows[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(parts(t), parts(edited))) and r["near_next"] == pytest.approx(like(parts(t), parts(after)))
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] != rows[3]["fingerprint"]


def test_licenses(spark, docs, none):
    rows = licenses.scan(spark, docs).collect()
    assert licenses.scan(spark, none).count() == 0 and len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert (by[9]["n_words"], by[9]["n_base"], by[9]["first_word"], by[9]["last_word"], by[9]["base_labels"]) == (6, 3, 0, 4, "apache,mit")
    assert (by[15]["n_base"], by[15]["base_labels"], by[15]["n_words"]) == (1, "gpl", 8)
    assert by[7]["n_words"] == by[6]["n_words"] == 0 and by[7]["first_word"] is None and by[1]["labels"] == ""
    notice = spark.createDataFrame([(1, "Licensed under the very same Apache License, Version 2.0"), (2, "licensed under the apache foo")], "doc_id long, text string")
    assert [r["labels"] for r in licenses.scan(spark, notice).orderBy("doc_id").collect()] == ["apache,apache-2.0", ""]


def test_passages(spark, docs, none):
    rows = passages.report(spark, docs).collect()
    assert passages.report(spark, none).count() == 0 and len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["class_id"] == by[2]["class_id"] == by[3]["class_id"] == 1 and by[3]["n_shared"] >= 100
    assert by[4]["class_id"] == by[5]["class_id"] == 4 and by[4]["passages"] == "40-99" and by[5]["passages"] == "0-59"
    assert by[10]["class_id"] == by[11]["class_id"] == 10
    assert all(by[d]["n_passages"] == 0 and by[d]["class_id"] == d for d in (6, 7, 8, 12, 13, 14, 16))


def test_passages_link_all_holders(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(4000)) for _ in range(n))
    wide = text(40)
    rows = [(d, text(20) + " " + wide + " " + text(20)) for d in range(7)]  # seven hold one passage
    rows += [(7, rows[3][1])]  # and an equal text
    for d in range(10, 50, 2):  # passages of the least length, often with a single seed
        short = text(passages.LEAST_WORDS)
        rows += [(d, text(25) + " " + short + " " + text(25)), (d + 1, text(35) + " " + short)]
    lines = [text(21) for _ in range(2)]  # B (61) and C (62) share both lines in a row, others one only
    rows += [(60 + i, " ".join([text(30), *lines, text(30)]) if i in (1, 2) else text(30) + " " + lines[i % 2] + " " + text(30)) for i in range(6)]
    got = {r["doc_id"]: r for r in passages.report(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: got[d]["n_links"] for d in range(8)} == dict.fromkeys(range(8), 7)
    assert all(got[d]["n_links"] == 1 and got[d]["class_id"] == d // 2 * 2 and got[d]["n_shared"] >= passages.LEAST_WORDS for d in range(10, 50))
    assert {d: (got[d]["n_links"], got[d]["class_id"]) for d in (60, 61, 62, 63)} == {60: (0, 60), 61: (1, 61), 62: (1, 61), 63: (0, 63)}


def test_passages_that_others_hold_in_part(spark):
    """A passage of two texts of which 48 others hold 28 words; and texts with every sixth word changed."""
    rng = random.Random(21)
    text = lambda n: [rng.choice(WORDS) + str(rng.randrange(4000)) for _ in range(n)]
    passage = text(60)
    rows = [(d, " ".join([*text(40), *passage, *text(40)])) for d in (0, 1)]
    for d in range(2, 50):
        lo = rng.randrange(0, 33)
        rows.append((d, " ".join([*text(30), *passage[lo : lo + 28], *text(30)])))
    edited = range(100, 160, 2)
    for d in edited:
        own = text(200)
        rows += [(d, " ".join(own)), (d + 1, " ".join(w if i % 6 else "changed" + str(rng.randrange(9999)) for i, w in enumerate(own)))]
    got = {r["doc_id"]: r for r in passages.report(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["class_id"] == got[1]["class_id"] == 0 and got[0]["passages"] == got[1]["passages"] == "40-99"
    assert all(got[d]["n_links"] == 0 for d in range(2, 50))
    assert sum(got[d + 1]["class_id"] == d for d in edited) >= 0.9 * len(edited)


def test_sql_of_licenses_and_shards(spark):
    import duckdb

    from docquarry.llm import registry

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    for name, sql in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        want = con.execute(sql)
        order = [df.columns.index(d[0]) for d in want.description]
        assert sorted((tuple(r[i] for i in order) for r in df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_chains_by_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randrange(2, 9)
        at, other = sorted(rng.sample(range(60), n)), [rng.randrange(60) for _ in range(n)]
        gap = lambda i, j: passages.SKIP_COST * ((at[j] - at[i]) + (other[j] - other[i]) - 2 * passages.K) / 2
        best = 0.0
        for mask in range(1, 1 << n):
            path = [i for i in range(n) if mask >> i & 1]
            if all(other[a] < other[b] for a, b in zip(path, path[1:])):
                best = max(best, passages.K * len(path) - sum(gap(a, b) for a, b in zip(path, path[1:])))
        found = passages.chains(at, other)
        score = lambda p: passages.K * len(p) - sum(gap(a, b) for a, b in zip(p, p[1:]))
        assert max((score(p) for p in found), default=passages.K) == pytest.approx(max(best, passages.K) if found else passages.K)


def test_sentencepiece(spark, docs, none):
    pieces = sentencepiece.load_pieces(sentencepiece.MODEL_PATH)
    rows = sentencepiece.encode_documents(docs, pieces).collect()
    assert sentencepiece.encode_documents(none, pieces).count() == 0 and len(rows) == len(ROWS) and all(r["round_trip"] for r in rows)
    codec = sentencepiece.Codec(pieces)
    for text in ("", " ", "a▁b ▁", "tab\tnew\n\nline", "日本語 😀", "  two  blanks "):
        assert codec.decode(codec.encode(text)) == text
    library = spm.SentencePieceProcessor(model_file=sentencepiece.MODEL_PATH)
    rng = random.Random(8)
    odd = ["".join(rng.choice("abcdefghijklmn  \n\t.,éü日本😀ZQ0123") for _ in range(rng.randrange(40))) for _ in range(500)]
    for text in [t for _, t in pairs() if t and "▁" not in t] + odd:
        assert codec.encode(text).tolist() == library.encode(text)
    likely = sentencepiece.Codec(dataclasses.replace(pieces, merges=False))  # the same pieces as a model of probabilities
    names = {n.replace("▁", " "): (pieces.scores[i], i) for i, n in enumerate(pieces.names) if i not in set(pieces.byte_ids) | pieces.silent}
    for text in [t[:300] for _, t in pairs() if t]:
        best = [(0.0, [])] + [None] * (len(text) + 1)
        text = " " + text
        for e in range(1, len(text) + 1):
            options = [(best[s][0] + names[text[s:e]][0], s) for s in range(e) if text[s:e] in names]
            if text[e - 1] not in names:
                options.append((best[e - 1][0] + likely.floor, e - 1))
            best[e] = (max(options)[0], None)
        got = likely.encode(text[1:])
        assert likely.decode(got) == text[1:]
        total = sum(pieces.scores[i] for i in got if i not in pieces.byte_ids)
        rare = sum(text[k] not in names for k in range(len(text)))
        assert total + rare * likely.floor == pytest.approx(best[len(text)][0])
    assert spm.SentencePieceProcessor(model_file=sentencepiece.MODEL_PATH).decode(codec.encode("plain words here").tolist()) == "plain words here"


def test_toxicity(spark, none):
    rng = random.Random(4)
    bad = ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for d in range(600):
        toxic = d % 6 == 0
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    rows += [(None, "vile rotten nasty"), (700, None), (701, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(spark, docs, marks).collect()}
    held = [d for d, _ in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] == (d in held) for d, _ in labels)
    assert sum((got[d]["score"] >= 0.5) == (d % 6 == 0) for d in held) >= 0.98 * len(held)
    assert got[700]["predicted"] == got[701]["predicted"] == 0 and got[None]["predicted"] == 1 and got[None]["held_out"]
    kept = toxicity.keep_clean(spark, docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())
    assert toxicity.score_toxicity(spark, none, marks).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(spark, docs, marks.where("toxic = 0")).collect()} == {0.0}


def test_names_that_clash_long_texts_and_ties(spark):
    """Extra columns with the operators' own names, a very long text, nulls, ties and repeated vectors."""
    rng = random.Random(9)
    rows = [(d, " ".join(rng.choice(WORDS) for _ in range(30)) + (" vile rotten" if d % 4 == 0 else ""), 7, "x", 1.5, 3) for d in range(120)]
    rows += [(200, "word " * 400_000 + "vile rotten " * 3000, 7, "x", 1.5, 3), (201, None, None, None, None, None), rows[4], rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, terms string, counts double, n_words int")
    marks = spark.createDataFrame([(d, int(d % 4 == 0), "x") for d in range(120)], "doc_id long, toxic int, text string")
    scored = toxicity.score_toxicity(spark, docs, marks).collect()
    assert len(scored) == len(rows) and sum(r["doc_id"] == 4 for r in scored) == 3 and all(0 <= r["score"] <= 1 for r in scored)
    kept = toxicity.keep_clean(spark, docs, marks)
    clean = {r["doc_id"] for r in scored if not r["predicted"]}
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {r for r in rows if r[0] in clean}

    same = [(i, [1.0, 0.0], 9, 9, "m") for i in (0, 7, 3, 5, 40)] + [(9, [0.0, 1.0], 9, 9, "m")]
    found = ann.nearest(spark, spark.createDataFrame(same, "vec_id long, embedding array<double>, q int, c int, members string"), top=3).collect()
    by = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found}
    assert by == {(0, 1): (3, 1.0), (0, 2): (5, 1.0), (0, 3): (7, 1.0), (40, 1): (0, 1.0), (40, 2): (3, 1.0), (40, 3): (5, 1.0)}


def test_block_max_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(500):
        t = np.unique(rng.integers(0, 40, rng.integers(1, 8)))
        w = rng.random(len(t)).astype(np.float32)
        vectors.append((t, w / np.linalg.norm(w)))
    dense = np.zeros((500, 40))
    for row, (t, w) in zip(dense, vectors):
        row[t] = w
    index = toxicity.BlockMaxIndex(vectors, 40)
    for i in range(0, 500, 7):
        ids, cosines = index.nearest(*vectors[i], 10, skip=(i, i + 1))
        scores = dense @ dense[i]
        scores[i] = -1
        want = np.lexsort((np.arange(500), -np.round(scores, 6)))[:10]
        assert np.allclose(cosines, scores[want], atol=1e-5) and i not in ids


def test_nearest(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 24))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(4000, None), (4020, [0.0] * 24), (4040, [float("nan")] * 24), (4060, [None] * 24), (4080, [1.0] * 3), (4100, [2.0] * 3), (None, rows[1][1]), rows[20], (5000, rows[21][1]), (5001, rows[21][1])]
    got = ann.nearest(spark, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r)
    assert set(by) == {i for i in range(0, 3000, 20)} | {5000, 4080, 4100}
    assert [tuple(r)[1:3] for r in by.pop(4080) + by.pop(4100)] == [(1, 4100), (1, 4080)]
    twice = by.pop(20)
    assert len(twice) == 40 and {r["rank"] for r in twice if r["vec_id"] == 20} == {1} and sum(r["vec_id"] == 20 for r in twice) == 2
    vectors = np.array([np.float32(v) for v in vectors], dtype=np.float64)
    both, ids = np.vstack([vectors, vectors[20], vectors[21], vectors[21]]), np.array([*range(3000), 20, 5000, 5001])
    hits = total = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        scores = both @ both[np.flatnonzero(ids == q)[0]]
        scores[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -scores))[:20]]
        hits, total = hits + len(set(want) & {r["vec_id"] for r in found}), total + 20
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(a["score"] >= b["score"] for a, b in zip(found, found[1:]))
        assert all(r["score"] == pytest.approx(scores[np.flatnonzero(ids == r["vec_id"])[0]]) for r in found)
    assert hits / total >= 0.95
    assert ann.nearest(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(70)
    rows = [(d, text(50), "en", f"src{d % 3}", 0) for d in range(300)]
    for d in range(0, 300, 6):
        rows[d] = (d, rows[d][1] + " vile rotten nasty" * 2, "en", "src0", 0)
    rows[11], rows[13] = (11, rows[7][1], "en", "src1", 0), (13, passage + " " + text(40), "en", "src2", 0)
    rows[15] = (15, text(40) + " " + passage, "en", "src2", 0)
    folder = str(tmp_path / "tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d % 6 == 0)) for d in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == {d for d in range(300) if d % 6 and d != 11} and all(r["round_trip"] for r in got.values())
    # The stages after the learned one by brute force: fingerprints, windows, turns of equal sources, the library's ids.
    left = sorted(r for r in rows if r[0] % 6)
    fps = {r[0]: slow_simhash(r[1]) for r in left}
    group = {d: d for d in fps}
    for a in sorted(fps):
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                low = min(group[a], group[b])
                group = {d: low if g in (group[a], group[b]) else g for d, g in group.items()}
    left = [r for r in left if group[r[0]] == r[0]]
    kept = [k.decode("utf-8", "ignore") for k in slow_cut([r[1].encode() for r in left], True)]
    turns = []
    for j, source in enumerate(sorted({r[3] for r in left})):
        own = [(r[0], xxhash.xxh64_intdigest(k)) for r, k in zip(left, kept) if r[3] == source]
        turns += [(j + 3 * (n // 16), n % 16, d) for n, (d, _) in enumerate(own)]
    slot = {t: i for i, t in enumerate(sorted({t for t, _, _ in turns}))}
    library = spm.SentencePieceProcessor(model_file=sentencepiece.MODEL_PATH)
    want = {d: (slot[t], n) for t, n, d in turns}
    assert {d: (r["slot"], r["row"]) for d, r in got.items()} == want
    assert {d: r["ids"] for d, r in got.items()} == {r[0]: library.encode(k) for r, k in zip(left, kept)}
    codec = sentencepiece.Codec(sentencepiece.load_pieces(sentencepiece.MODEL_PATH))
    assert passage[5:200] not in codec.decode(got[13]["ids"]) and codec.decode(got[7]["ids"]) == rows[7][1]


def test_pipeline_returns_the_mix(spark, docs, tmp_path):
    import corpus_pipeline

    rows = [(d, f"text {d}", "en", "big" if d % 3 else "small", 0) for d in range(3 * 7998)] + [(0, "text 0", "en", "small", 0)] * 2
    at = str(tmp_path / "mixed")
    corpus_pipeline.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").write.parquet(at)
    got = sorted((r["slot"], r["row"], r["doc_id"]) for r in corpus_pipeline.encode(spark, spark.read.parquet(at), "").collect())
    assert len(got) == len({g[:2] for g in got}) == len(rows) and sorted(g[2] for g in got) == sorted(r[0] for r in rows)
    blocks = {slot: "big" if d % 3 else "small" for slot, _, d in got}
    assert sorted(blocks) == list(range(len(blocks)))
    small = np.cumsum([blocks[s] == "small" for s in range(2 * 500)])  # until its 8000 rows are out, half of every prefix
    assert small[-1] == 500 and (abs(small - np.arange(1, 1001) / 2) < 1).all()
    odd = mixing.with_slots(spark, docs).collect()
    assert sorted((r["slot"], r["row"]) for r in odd) == sorted((r["slot"], r["row"]) for r in mixing.mix_sources(spark, docs).collect())


def test_shared_folder_comes_from_the_session(spark):
    assert common.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
