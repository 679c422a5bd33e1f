"""Types, dates and names of files, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by kind, header words that are no entities.
EMAIL = ("message/rfc822", "application/mbox", "application/vnd.ms-outlook")
TABLE = ("text/csv", "text/tab-separated-values", "application/vnd.ms-excel", "application/vnd.oasis.opendocument.spreadsheet")
ARCHIVE = ("application/zip", "application/x-tar", "application/gzip", "application/x-7z-compressed", "application/vnd.rar")
HEADERS = ("re", "fw", "fwd", "cc", "bcc", "to", "from", "subject", "date", "sent")
#: From the most telling kind to the least.
LADDER = ("email", "office", "table", "pdf", "html", "image", "video", "audio", "archive", "text", "other")


def coarse_type(mime: Column) -> Column:
    begins = lambda p: F.startswith(mime, F.lit(p))
    return (
        F.when(mime.isin(*EMAIL), "email").when(mime.isin(*TABLE) | F.contains(mime, F.lit("spreadsheetml")), "table").when(mime.isin(*ARCHIVE), "archive")
        .when(mime == "application/pdf", "pdf").when(mime == "text/html", "html").when(begins("text/"), "text").when(begins("image/"), "image")
        .when(begins("video/"), "video").when(begins("audio/"), "audio").otherwise("other")
    )


def is_zip_document(mime: Column) -> Column:
    return mime.rlike("officedocument|opendocument|epub")


def canonical_type(mimes: Column, members: Column) -> Column:
    """(kind, decided_by): zip-based documents first, archives only with members, else the most telling kind found."""
    kinds = F.transform(mimes, lambda m: F.when(is_zip_document(m) & ~F.contains(m, F.lit("spreadsheet")), "office").otherwise(coarse_type(m)))
    fair = F.filter(kinds, lambda k: (k != "archive") | (members > 0))
    best = F.array_min(F.transform(fair, lambda k: F.array_position(F.array(*[F.lit(x) for x in LADDER]), k)))
    kind = F.coalesce(F.get(F.array(*[F.lit(x) for x in LADDER]), (best - 1).cast("int")), F.lit("other"))
    by = F.when(kind == "other", "none").when(kind == "archive", "members").when(kind == "office", "zip document").otherwise("content")
    return F.struct(kind.alias("kind"), by.alias("decided_by"))


def sniff_table(text: Column, least_lines: int = 5) -> Column:
    """(sep, fields, lines) of a rectangular table, or null. The separator of most fields wins, then by , TAB ; |."""
    lines = F.split(text, "\n")
    tried = []
    for rank, sep in ((4, ","), (3, "\t"), (2, ";"), (1, "|")):
        fields = _counts(lines, sep)
        ok = (F.size(fields) >= least_lines) & (F.get(fields, F.lit(0)) > 1) & (F.size(F.array_distinct(fields)) == 1)
        tried.append(F.when(ok, F.struct(F.get(fields, F.lit(0)).alias("fields"), F.lit(rank).alias("rank"), F.size(fields).alias("lines"), F.lit(sep).alias("sep"))))
    best = F.array_max(F.array(*tried))
    return F.when(best.isNotNull(), F.struct(best["sep"].alias("sep"), best["fields"].alias("fields"), best["lines"].alias("lines")))


def _counts(lines: Column, sep: str) -> Column:
    return F.transform(lines, lambda line: F.size(F.split(line, r"\Q" + sep + r"\E")))


def is_stopped_entity(value: Column) -> Column:
    """Whether a found entity is noise: too short, no letters, a mail header, or encoded."""
    bare = F.lower(F.trim(value))
    switches = F.regexp_count(value, F.lit("[a-z][A-Z]|[A-Z][a-z]"))
    encoded = ~F.contains(value, F.lit(" ")) & (F.length(value) >= 16) & (switches >= 5)
    return (F.length(bare) < 2) | ~value.rlike("[A-Za-zÀ-ÿ]") | bare.isin(*HEADERS) | F.lower(value).rlike(r"^(from|to|cc|subject|sent|date)\s*:") | encoded


def parse_date(raw: Column) -> Column:
    """Seconds since 1970 of ISO dates and times and of PDF dates; without an offset, UTC; else null."""
    pdf = F.regexp_replace(raw, r"^D:([0-9]{14}).*$", "$1")
    tries = [
        F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(pdf, F.lit("yyyyMMddHHmmss")),
    ]
    return F.unix_seconds(F.coalesce(*tries))


def nearest_second(at: Column) -> Column:
    """A time rounded to the nearest second, halves to the even one."""
    return F.timestamp_seconds(F.rint(F.unix_micros(at.cast("timestamp")) / 1e6).cast("long"))


def sane_date(seconds: Column, now: Column) -> Column:
    """From 1800 to a year after now."""
    return seconds.between(F.lit(-5364662400), F.unix_seconds(now) + 365 * 86400)


def normalise_path(path: Column) -> Column:
    """One slash before each part, none after the last; the root is /."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def ancestors(path: Column) -> Column:
    """Folders above a normalised path, from the root on."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.when(F.size(parts) > 0, up).otherwise(F.array().cast("array<string>"))


#: Media types by the end of a file's name.
EXTENSIONS = {"html": "text/html", "htm": "text/html", "pdf": "application/pdf", "zip": "application/zip", "csv": "text/csv", "txt": "text/plain"}


def mime_of_extension(ext: Column) -> Column:
    """The media type that a name's end stands for; without one, plain bytes."""
    out = F.lit("application/octet-stream")
    for end, mime in EXTENSIONS.items():
        out = F.when(ext == end, mime).otherwise(out)
    return out


def is_mail(text: Column, least: int = 3, lines: int = 20) -> Column:
    """Whether `least` of the first lines are mail headers."""
    head = F.slice(F.split(text, "\n"), 1, lines)
    return F.size(F.filter(head, lambda line: line.rlike("^(From|To|Cc|Subject|Date|Message-ID|Received|MIME-Version): "))) >= least
