"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reply and forward marks, and query parameters that only track.
SUBJECT_PREFIXES = ("re", "fw", "fwd", "aw", "wg", "sv", "vs", "antw", "tr", "rv")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")
_PREFIX = r"^(?:\s*(?:" + "|".join(SUBJECT_PREFIXES) + r")\s*(?:\[\d+\])?\s*:)+\s*"


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalise_subject(subject: Column) -> Column:
    """Without reply and forward marks, white space collapsed, lower case."""
    bare = F.regexp_replace(F.lower(subject), _PREFIX, "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def subject_prefix_kind(subject: Column) -> Column:
    """reply, forward or none, by the outermost mark."""
    first = F.regexp_extract(F.lower(subject), r"^\s*([a-z]+)\s*(?:\[\d+\])?\s*:", 1)
    return (
        F.when(first.isin("fw", "fwd", "wg", "vs", "tr", "rv"), "forward").when(first.isin("re", "aw", "sv", "antw"), "reply").otherwise("none")
    )


def normalise_message_id(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, "[<>]", "")))


def split_message_ids(header: Column) -> Column:
    return F.transform(F.regexp_extract_all(header, F.lit("<[^<>]+>"), F.lit(0)), normalise_message_id)


def normalise_url(url: Column) -> Column:
    """Host without www. or m., path without its last slash, query sorted and without tracking, no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).isin(*TRACKING))
    return F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(asked), "&"))).otherwise(""))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def quote_form(text: Column) -> Column:
    """How quotes and texts are compared: plain quotes, white space collapsed, lower case."""
    return F.lower(collapse(F.translate(text, "“”‘’«»", "\"\"''\"\"")))


def quote_occurs(quote: Column, text: Column, least: int = 12) -> Column:
    return (F.length(quote_form(quote)) >= least) & F.contains(quote_form(text), quote_form(quote))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags removed, common entities resolved, white space collapsed."""
    body = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(body, r"(?s)<[^>]*>", " ")
    for mark, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(mark), F.lit(char))
    return collapse(bare)


def non_linguistic_reason(text: Column) -> Column:
    """Why a text isn't prose, or null: encoded, single_chars, numeric or few_letters. Texts under 120 characters always pass."""
    n = F.length(text)
    words = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    encoded = F.aggregate(F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/=]{40,}"), F.lit(0)), F.lit(0), lambda a, r: a + F.length(r))
    single = F.size(F.filter(words, lambda t: F.length(t) == 1))
    numeric = F.size(F.filter(words, lambda t: t.rlike("^[0-9.,:%-]+$")))
    letters = F.length(F.regexp_replace(text, "[^A-Za-zÀ-ÿ]", ""))
    return (
        F.when(n < 120, F.lit(None).cast("string"))
        .when(encoded > 0.3 * n, "encoded")
        .when(single > 0.55 * F.size(words), "single_chars")
        .when((F.size(words) >= 30) & (numeric > 0.8 * F.size(words)), "numeric")
        .when(letters < 0.2 * n, "few_letters")
    )


def highlight(text: Column, terms: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """Mark the terms, longest first, whatever their case."""
    ordered = sorted({t.lower() for t in terms if t}, key=lambda t: (-len(t), t))
    pattern = "(?i)(" + "|".join(r"\Q" + t + r"\E" for t in ordered) + ")"
    return F.regexp_replace(text, pattern, f"{before}$1{after}") if ordered else text


def snippet(text: Column, term: str, around: int = 50, most: int = 400) -> Column:
    """Text around the first place of a term."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substr(text, start, F.least(F.lit(most), at - start + len(term) + around))).otherwise(F.substr(text, F.lit(1), F.lit(most)))


def money_bucket(amount: Column, currency: Column, edges: tuple[int, ...] = (10, 100, 1000, 10000, 100000, 1000000)) -> Column:
    """The currency and the bucket of the amount's size: below each edge, or at least the last."""
    size = F.abs(amount)
    out = F.when(size < edges[0], F.lit(f"<{edges[0]}"))
    for lo, hi in zip(edges, edges[1:], strict=False):
        out = out.when(size < hi, F.lit(f"{lo}-{hi}"))
    return F.concat(currency, F.lit(":"), out.otherwise(F.lit(f">={edges[-1]}")))


def snap_to_day(seconds: Column) -> Column:
    """The second at which a UTC day begins, also before 1970."""
    return (F.floor(seconds / 86400) * 86400).cast("long")


def size_bucket(size: Column) -> Column:
    return F.when(size < 1000, "0-1k").when(size < 5000, "1k-5k").when(size < 20000, "5k-20k").otherwise("20k+")


def slug(name: Column, most: int = 48) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one underscore, none at the ends."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, most)


def unwrap_redirect(url: Column) -> Column:
    """The target in a redirect's url=, u= or q= parameter, decoded; else the URL itself."""
    inner = F.regexp_extract(url, r"[?&](?:url|u|q)=(https?(?:://|%3A%2F%2F)[^&#]*)", 1)
    return F.when(inner != "", F.url_decode(inner)).otherwise(url)


def display_url(url: Column) -> Column:
    """Host, then the path's parts."""
    bare = F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z]+://(?:www[.])?", ""), "[?#].*$", "")
    return F.replace(F.regexp_replace(bare, "/+$", ""), F.lit("/"), F.lit(" > "))


def truncate_words(text: Column, most: int) -> Column:
    """At most that many characters, cut after a whole word where there is one."""
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.substring(text, 1, most), r"\s+\S*\z", ""))


def term_id(field: Column, value: Column) -> Column:
    """An id below 2^60 from the term itself, so that no dictionary need be asked."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", field, value)), 1, 15), 16, 10).cast("long")


def variant_key(engine: Column, languages: Column) -> Column:
    return F.concat(F.lit("ocr:"), engine, F.lit(":"), F.array_join(F.array_sort(languages), "+"))


def parse_variant_key(key: Column) -> Column:
    """(engine, languages) of an OCR variant's key; nulls for other variants."""
    ok = key.rlike("^ocr:[^:]+:[^:]+$")
    part = lambda i: F.when(ok, F.regexp_extract(key, "^ocr:([^:]+):([^:]+)$", i))
    return F.struct(part(1).alias("engine"), F.split(part(2), "[+]").alias("languages"))


def first_header(pairs: Column, name: str) -> Column:
    """The first value of a header in a JSON list of [name, value] pairs, whatever its case."""
    parsed = F.from_json(pairs, "array<array<string>>")
    return F.get(F.filter(parsed, lambda p: F.lower(F.get(p, F.lit(0))) == name.lower()), F.lit(0))[1]


def embedding_input(text: Column, kind: str) -> Column:
    """Text as an embedding model wants it: query or passage."""
    return F.concat(F.lit(f"{kind}: "), collapse(text))
