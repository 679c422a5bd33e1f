"""Search over a table of texts: token predicates, BM25, facets, histograms, pages.

Predicates are Columns over a token array and combine with & | ~, so that Catalyst sees one filter;
there is no query language to parse.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def has(tokens: Column, term: str) -> Column:
    return F.array_contains(tokens, term.lower())


def all_of(tokens: Column, terms: Sequence[str]) -> Column:
    return reduce(Column.__and__, [has(tokens, t) for t in terms], F.lit(True))


def any_of(tokens: Column, terms: Sequence[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(t.lower()) for t in terms]))


def quorum(tokens: Column, terms: Sequence[str], n: int) -> Column:
    """At least n of the terms."""
    return sum((has(tokens, t).cast("int") for t in terms), F.lit(0)) >= n


def wildcard(tokens: Column, pattern: str) -> Column:
    """A token like the pattern, where * stands for anything."""
    return F.exists(tokens, lambda t: t.like(pattern.lower().replace("%", r"\%").replace("_", r"\_").replace("*", "%")))


def phrase(tokens: Column, words: Sequence[str]) -> Column:
    """The words one after another: a search of the joined tokens, no positions needed."""
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(" " + " ".join(w.lower() for w in words) + " "))


def positions(tokens: Column, term: str) -> Column:
    return F.filter(F.transform(tokens, lambda t, i: F.when(t == term.lower(), i)), lambda i: i.isNotNull())


def near(tokens: Column, a: str, b: str, within: int) -> Column:
    """Both terms, in either order, at most `within` tokens apart."""
    return F.exists(positions(tokens, a), lambda i: F.exists(positions(tokens, b), lambda j: F.abs(i - j) <= within))


def starts(tokens: Column, term: str) -> Column:
    return F.get(tokens, F.lit(0)) == term.lower()


def bm25(df: DataFrame, tokens: str, terms: Mapping[str, float] | Sequence[str]) -> DataFrame:
    """Add `score`, with term weights if given. Statistics are those of all of df, in one row."""
    boost = dict(terms) if isinstance(terms, Mapping) else {t: 1.0 for t in terms}
    counted = df.withColumn("_dl", F.size(tokens)).withColumns({f"_tf{i}": _frequency(F.col(tokens), t) for i, t in enumerate(boost)})
    stats = counted.agg(
        F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(boost))]
    )
    score = F.lit(0.0)
    for i, weight in enumerate(boost.values()):
        tf, seen = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_n") - seen + 0.5) / (seen + 0.5))
        score = score + weight * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    return counted.crossJoin(F.broadcast(stats)).withColumn("score", score).select(*df.columns, "score")


def _frequency(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term.lower()))


def facet(df: DataFrame, value: Column | str, doc: Sequence[str], most: int | None = None) -> DataFrame:
    """Distinct documents of each value, most first, then by value."""
    value = F.col(value) if isinstance(value, str) else value
    counts = df.select(value.alias("value"), *doc).distinct().groupBy("value").agg(F.count("*").alias("docs"))
    return counts.orderBy(F.desc("docs"), "value").limit(most) if most else counts


def filtered(df: DataFrame, predicates: Mapping[str, Column], without: str | None = None) -> DataFrame:
    """All predicates but a facet's own."""
    return df.where(reduce(Column.__and__, [p for name, p in predicates.items() if name != without], F.lit(True)))


def date_overlap(lo: Column, hi: Column, start: Column | None, end: Column | None, unknown: str = "exclude") -> Column:
    """Whether [lo, hi] meets [start, end], either of which may be open. unknown: include, exclude or only."""
    known = F.lit(True)
    if end is not None:
        known = known & (lo <= end)
    if start is not None:
        known = known & (hi >= start)
    missing = lo.isNull() | hi.isNull()
    return missing if unknown == "only" else (F.coalesce(known, F.lit(False)) | missing) if unknown == "include" else F.coalesce(known & ~missing, F.lit(False))


def any_between(values: Column, start: Column, end: Column) -> Column:
    return F.exists(values, lambda v: v.between(start, end))


def bucket_of(value: Column, edges: Sequence[int]) -> Column:
    """How many edges are at most the value: 0 below the first."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= value))


#: Widths in seconds that a histogram's bins may have.
WIDTHS = (60, 300, 900, 3600, 10800, 21600, 43200, 86400, 172800, 604800, 1209600, 2592000, 7776000, 15552000, 31536000, 63072000, 157680000, 315360000)


def histogram_edges(start: int, end: int, cuts: Sequence[int] = (), target: int = 24, most: int = 30) -> list[int]:
    """Edges that tile [start, end): the least width with no more than `target` bins, cut also at the given points."""
    span = max(1, end - start)
    width = next((w for w in WIDTHS if -(-span // w) <= target), -(-span // target))
    first = start // width * width
    edges = {e for e in range(first, end + width, width)} | {c for c in cuts if start < c < end}
    ordered = sorted(edges)
    while len(ordered) - 1 > most:
        ordered = [e for i, e in enumerate(ordered) if i % 2 == 0 or e in cuts or e == ordered[-1]]
    return ordered


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int = 20, key: str = "doc_id") -> DataFrame:
    """One page of the total order, with each row's neighbours for links back and forth.

    Only the rows up to the page's end and one beyond are sorted together.
    """
    top = df.orderBy(*order).limit((number + 1) * size + 1)
    w = Window.orderBy(*order)
    return (
        top.withColumn("row", F.row_number().over(w)).withColumn("prev_key", F.lag(key).over(w)).withColumn("next_key", F.lead(key).over(w))
        .where((F.col("row") > number * size) & (F.col("row") <= (number + 1) * size))
    )


#: Columns that filters and facets may name.
FIELDS = (
    "collection_dataset", "file_types", "file_extensions", "mime_types", "languages", "email_from", "email_to", "email_domains", "entities", "locations", "organisations", "persons",
    "dates", "mentioned_dates", "file_size_bytes", "money", "tags", "ancestors",
)


def queryable(field: str) -> str:
    """The field itself, if filters may name it."""
    if field not in FIELDS:
        raise ValueError(f"no such field: {field}")
    return field


def within(low: float | None, high: float | None, column: Column) -> Column:
    """A closed range that may be open at either end; with no bound all rows, nulls too."""
    if low is not None and high is not None and low > high:
        raise ValueError(f"the range from {low} to {high} is inverted")
    test = F.lit(True)
    if low is not None:
        test = test & (column >= low)
    if high is not None:
        test = test & (column <= high)
    return F.coalesce(test, F.lit(False)) if low is not None or high is not None else test


def order_of(name: str, asked: str, newest: Column, score: Column, keys: Sequence[str]) -> list[Column]:
    """Sort keys; by relevance without any words to match means by date. Ties go by the keys."""
    by = newest if name == "date" or not asked.strip() else score
    return [by.desc_nulls_last(), *[F.col(k).asc() for k in keys]]


def assert_readable(dataset: str, permitted: Sequence[str]) -> str:
    """The dataset itself, if the user may read it."""
    if dataset not in permitted:
        raise PermissionError(f"{dataset} may not be read")
    return dataset


def collections_of(selected: Sequence[str], known: Sequence[str]) -> list[str]:
    """Of known collections those that a selection of datasets, named collection_dataset, needs; all without a selection."""
    return [c for c in known if not selected or any(s == c or s.startswith(f"{c}_") for s in selected)]


def highlight_spans(text: Column, terms: Sequence[str]) -> Column:
    """(start, end) from 1, end not included, of the stretches that the terms cover, whatever their
    case; spans that overlap or touch are one."""

    def spans(term: str) -> Column:
        between = F.split(F.lower(text), "(?=" + re.escape(term.lower()) + ")")
        start = F.aggregate(between, F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.when(p.startswith(term.lower()), F.concat(s["out"], F.array(s["at"]))).otherwise(s["out"]).alias("out")))
        return F.transform(start["out"], lambda i: F.struct(i.alias("start"), (i + len(term)).alias("end")))

    every = F.array_sort(F.flatten(F.array(*[spans(t) for t in terms])))

    def join(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]), wider).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(every, F.slice(every, 1, 0), join)
