"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, slices, small_batches, table, trimmed

#: Bound of what is learned: labelled rows, those of the least xxhash64(doc_id). Terms are bounded by their texts.
EXAMPLES = 4096
#: How strongly a term must go with the labels (a log-likelihood ratio) to weigh half of its TF-IDF.
HALF = 5.0
#: Lengths of the word beginnings that are terms beside whole words.
PREFIXES = range(4, 9)
#: Rows of a block of the index; votes of a score; added to a distance before it weighs a vote.
BLOCK, VOTES, NEAR = 512, 10, 1e-4
#: Words, and term counts, whose results are remembered at most; characters of such a word.
MEMO, MEMO_SCORES, MEMO_CHARS = 1 << 15, 1 << 13, 40
_words = re.compile(r"\w+").findall


def word_counts(text: str | None) -> Counter[str]:
    return Counter(_words((text or "").lower()))


def terms_of(word: str) -> list[str]:
    """A word and, marked by a star, its beginnings."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class Counts:
    """Counts of the chosen terms in a text; what words give is remembered, up to a bound."""

    def __init__(self, terms: list[str]):
        self.at = {t: i for i, t in enumerate(terms)}
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[dict[int, int], int]:
        """({term: count}, number of words)"""
        memo, out = self.memo, {}
        counts = word_counts(text)
        for word, n in counts.items():
            own = memo.get(word)
            if own is None:
                own = tuple(self.at[t] for t in terms_of(word) if t in self.at)
                if len(word) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = own
            for term in own:
                out[term] = out.get(term, 0) + n
        return out, counts.total()


def weights(counts: dict[int, int], n_words: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of a unit vector. The last term stands for the rest of the text: it grows
    with its length, so that a chance hit in a long text counts less than in a short one."""
    at = np.fromiter([*sorted(counts), len(idf)], np.int64)
    w = np.array([(1 + math.log(counts[t])) * idf[t] for t in sorted(counts)] + [math.sqrt(math.log1p(n_words))])
    norm = math.sqrt(float(w @ w))
    return at, (w / norm if norm else w).astype(np.float32)


class BlockMaxIndex:
    """Postings by term, cut into blocks of examples; a block's best weight of each term bounds
    what its examples can reach, so that blocks are scored in the order of their bounds until no
    other can hold one of the nearest. The result is exact."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n = len(vectors)
        self.blocks = -(-self.n // BLOCK)
        ids = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        terms = np.concatenate([t for t, _ in vectors])
        values = np.concatenate([w for _, w in vectors])
        order = np.lexsort((ids, terms))
        self.ids, self.values, terms = ids[order], values[order], terms[order]
        cells = terms * self.blocks + self.ids // BLOCK
        self.start = np.searchsorted(cells, np.arange(n_terms * self.blocks + 1)).astype(np.int32)
        self.most = np.zeros(n_terms * self.blocks, np.float32)
        np.maximum.at(self.most, cells, self.values)
        self.most = self.most.reshape(n_terms, self.blocks)

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int, skip: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine, ties to the smaller number, and the cosines; skip: from, to before, which take no part."""
        bound = q @ self.most[terms]
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if len(best) == k and bound[b] < best[-1] - 1e-6:
                break
            got = np.zeros(BLOCK)
            at = terms * self.blocks + b
            for w, lo, hi in zip(q.tolist(), self.start[at].tolist(), self.start[at + 1].tolist(), strict=True):
                if hi > lo:
                    got[self.ids[lo:hi] - b * BLOCK] += w * self.values[lo:hi]
            own = np.arange(b * BLOCK, min(self.n, (b + 1) * BLOCK))
            got = got[: len(own)]
            others = (own < skip[0]) | (own >= skip[1])
            own, got = own[others], got[others]
            first = np.argsort(-np.round(got, 6), kind="stable")[:k]
            best_ids, best = np.concatenate((best_ids, own[first])), np.concatenate((best, got[first]))
            order = np.lexsort((best_ids, -np.round(best, 6)))[:k]
            best_ids, best = best_ids[order], best[order]
        return best_ids, best


def rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on x by pooling neighbours: (knots, values) for np.interp."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([yi, 1.0, xi, xi])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            v, n, lo, hi = pools.pop()
            u, m, lo, _ = pools[-1]
            pools[-1] = [(u * m + v * n) / (m + n), m + n, lo, hi]
    return (
        np.array([e for _, _, lo, hi in pools for e in (lo, hi)]),
        np.array([(v * n + 0.5) / (n + 1) if n < 20 else v for v, n, _, _ in pools for _ in (0, 1)]),
    )


@dataclass
class Model:
    """What is learned, of bounded size: EXAMPLES sparse vectors over the terms of their texts."""

    terms: list[str]
    idf: np.ndarray
    labels: np.ndarray
    names: np.ndarray
    index: BlockMaxIndex | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def vote(self, at: np.ndarray, w: np.ndarray, skip: tuple[int, int] = (0, 0)) -> tuple[float, np.ndarray, np.ndarray]:
        ids, cosines = self.index.nearest(at, w, VOTES, skip)
        weigh = 1 / (np.maximum(0, 1 - cosines) + NEAR)
        return float(weigh @ self.labels[ids] / weigh.sum()), ids, cosines

    def score(self, counts: dict[int, int], n_words: int) -> tuple[float, str]:
        """(score, evidence: the three nearest examples as doc_id:label:cosine)"""
        if self.index is None:
            return 0.0, ""
        raw, ids, cosines = self.vote(*weights(counts, n_words, self.idf))
        share = 0.02 * raw + 0.98 * float(np.interp(raw, *self.knots))
        seen = " ".join(f"{self.names[i]}:{self.labels[i]}:{c:.4f}" for i, c in zip(ids[:3], cosines))
        return min(1.0, max(0.0, share)), seen


def held_out() -> Column:
    """Whether a row is kept from learning: crc32 of its doc_id as text divides by 5 (or is null)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _term_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            found = sorted({t for w in word_counts(text.as_py()) for t in terms_of(w)})
            yield pa.record_batch({"term": pa.array(found, pa.string()), "label": pa.array([label] * len(found), pa.int32())})


def _counter(terms: list[str], keep: tuple[str, ...] = ("doc_id",)):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counts(terms)
        for batch in slices(batches):
            found = [count(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch(
                {c: batch.column(c) for c in keep}
                | {
                    "terms": pa.array([list(c) for c, _ in found], pa.list_(pa.int32())),
                    "counts": pa.array([list(c.values()) for c, _ in found], pa.list_(pa.int64())),
                    "n_words": pa.array([n for _, n in found], pa.int64()),
                }
            )

    return run


class Scores:
    """A model's scores; what equal counts give is remembered, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[tuple, tuple[float, str]] = {}

    def __call__(self, counts: dict[int, int], n: int) -> tuple[float, str]:
        key = (tuple(counts.items()), n if counts else n > 0)
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) >= MEMO_SCORES:
                self.memo.clear()
            found = self.memo[key] = self.model.score(counts, n)
        return found


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scores(model)
        for batch in slices(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("terms", "counts", "n_words")), strict=True)
            out = [score(dict(zip(terms, counts, strict=True)), n) for terms, counts, n in rows]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "score": pa.array([s for s, _ in out], pa.float64()),
                    "evidence": pa.array([e for _, e in out], pa.string()),
                }
            )

    return run


def choose_terms(sample: DataFrame) -> list[tuple[str, float]]:
    """(term, weight from 0 to 1) of all terms that toxic examples hold at over three times the rate
    of others. The weight tells how strongly a term goes with the label: r / (r + HALF) for a
    log-likelihood ratio r, so that a rare term counts, but little. No term is left out for its rank."""
    n1, n0 = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*") - F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n1 or not n0:
        return []
    counts = (
        sample.select("text", "label")
        .mapInArrow(trimmed(_term_labels), "term string, label int")
        .groupBy("term")
        .agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
        .where((F.col("a") > 0) & (F.col("a") / n1 > 3 * (F.col("b") + 0.5) / (n0 + 1)))
        .where((F.col("a") > 1) | ~F.col("term").endswith("*"))  # what begins a single example's word says no more than the word
    )
    clipped = lambda p: F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    like = lambda k, n, p: k * F.log(clipped(p)) + (n - k) * F.log(1 - clipped(p))
    a, b, p = F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / (n1 + n0)
    ratio = F.greatest(like(a, n1, a / n1) + like(b, n0, b / n0) - like(a, n1, p) - like(b, n0, p), F.lit(0.0))
    return [(r["term"], r["w"]) for r in counts.select("term", F.round(ratio / (ratio + HALF), 9).alias("w")).orderBy("term").collect()]


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and (doc_id, terms, counts, n_words) of every document.

    Labelled rows are a bounded sample; document frequencies are counted over all documents.
    """
    small_batches(spark)
    marked = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    sample = materialize(spark, docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "toxic-sample")
    chosen = choose_terms(sample)
    terms, strength = [t for t, _ in chosen], np.array([w for _, w in chosen])
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = "terms array<int>, counts array<long>, n_words long"
    counted = materialize(spark, docs.select("doc_id", "text").mapInArrow(trimmed(_counter(terms)), f"doc_id {kind}, {columns}"), "toxic-terms")
    idf = np.zeros(len(terms))
    total = counted.count()
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # no more than terms
        idf[r["t"]] = (math.log((total + 1) / (r["count"] + 1)) + 1) * strength[r["t"]]
    if not terms:
        return Model([], idf, np.empty(0), np.empty(0), None, None), counted
    examples = sample.select("doc_id", "label", "text").mapInArrow(trimmed(_counter(terms, ("doc_id", "label"))), f"doc_id {kind}, label int, {columns}")
    rows = [(r["label"], sorted(zip(r["terms"], r["counts"])), r["n_words"], r["doc_id"]) for r in examples.collect()]  # EXAMPLES rows, without their texts
    rows.sort(key=lambda r: r[:3] + (str(r[3]),))  # alike examples share blocks
    vectors = [weights(dict(found), n, idf) for _, found, n, _ in rows]
    model = Model(terms, idf, np.array([r[0] for r in rows]), np.array([r[3] for r in rows]), BlockMaxIndex(vectors, len(terms) + 1), None)
    raw = np.empty(len(rows))
    lo = 0
    for hi in range(1, len(rows) + 1):
        if hi == len(rows) or rows[hi][:3] != rows[lo][:3]:  # an example and its copies vote on none of them
            raw[lo:hi] = model.vote(*vectors[lo], skip=(lo, hi))[0]
            lo = hi
    model.knots = rising(raw, model.labels.astype(float))
    return model, counted


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text by its VOTES nearest labelled examples.

    Votes weigh by 1 / (1 - cosine + NEAR); the share of toxic votes is calibrated by isotonic
    regression on the examples, each scored without itself and its copies. Only the text is an input. Null and
    empty texts score as texts without any term do; without labels of both kinds all score 0; null
    doc_ids are never learned from; repeated rows are scored each; of several labels of a doc_id
    the greatest counts; equal cosines go to the example that comes first by label, terms and
    doc_id; other columns are ignored; an empty table gives an empty result.

    Returns doc_id, held_out, score, predicted, evidence.
    """
    model, counted = learn(spark, docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return counted.mapInArrow(trimmed(_scorer(model)), f"doc_id {kind}, score double, evidence string").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


def _clean(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, score = Counts(model.terms), Scores(model)
        for batch in slices(batches):
            clean = [score(*count(t.as_py()))[0] < 0.5 for t in batch.column("text")]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that `score_toxicity` doesn't predict toxic, with all their columns, whatever those are called."""
    model, _ = learn(spark, docs, labels)
    return docs.mapInArrow(trimmed(_clean(model)), docs.schema) if model.index is not None else docs


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return score_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
