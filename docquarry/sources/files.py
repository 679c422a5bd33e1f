"""Files as tables: folders, archives, mail, spreadsheets and office documents.

Bytes come from Spark's binaryFile reader, so any store that Spark reads will do; a small parser
turns the bytes of one file into rows inside the tasks.
"""

from __future__ import annotations

import csv
import email
import email.policy
import hashlib
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from email.utils import getaddresses
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType

#: Limits of what one file may unfold to.
MOST_MEMBERS, MOST_BYTES = 10_000, 256 << 20


def scan_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified, content) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


@pandas_udf(StringType())
def sha3_256(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else hashlib.sha3_256(b).hexdigest())


@pandas_udf(LongType())
def hash63(text: pd.Series) -> pd.Series:
    """The text's BLAKE2b of eight bytes, modulo 2^63."""
    return text.map(lambda t: int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "big") % 2**63)


def digests(files: DataFrame) -> DataFrame:
    content: Column = F.col("content")
    return files.withColumns({"md5": F.md5(content), "sha1": F.sha1(content), "sha256": F.sha2(content, 256), "sha3_256": sha3_256(content)})


def unfold(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]], columns: str) -> DataFrame:
    """Rows that `parse` makes of each file's content, with the file's path; `error` holds what went
    wrong in a file that can't be read, in a row of its own."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                try:
                    rows += [(path, *row, None) for row in parse(content)]
                except Exception as e:  # noqa: BLE001  any malformed file
                    rows.append((path, *[None] * len(names), f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["path", *names, "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, {columns}, error string")


def archive_members(content: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(member, size, data) of a zip or tar archive."""
    total = 0
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist()[:MOST_MEMBERS]:
                total += info.file_size
                if total > MOST_BYTES:
                    raise ValueError("archive unfolds to too much")
                if not info.is_dir():
                    yield info.filename, info.file_size, z.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for info in t:
                total += info.size
                if total > MOST_BYTES:
                    raise ValueError("archive unfolds to too much")
                if info.isfile():
                    yield info.name, info.size, t.extractfile(info).read()


ARCHIVE_COLUMNS = "member string, size long, data binary"


def mail_rows(content: bytes) -> Iterator[tuple]:
    """(message_id, subject, date_s, refs, addresses, body, attachments) of a message."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    people = [f"{kind}:{a.lower()}" for kind in ("from", "to", "cc", "bcc") for _, a in getaddresses([str(v) for v in message.get_all(kind, [])]) if a]
    body = message.get_body(("plain", "html"))
    date = message["date"].datetime.timestamp() if message["date"] and message["date"].datetime else None
    refs = " ".join(str(message[h]) for h in ("in-reply-to", "references") if message[h])
    yield (
        str(message["message-id"] or ""), str(message["subject"] or ""), None if date is None else int(date), refs, people, body.get_content() if body else "",
        [a.get_filename() or "" for a in message.iter_attachments()],
    )


MAIL_COLUMNS = "message_id string, subject string, date_s long, refs string, addresses array<string>, body string, attachments array<string>"
CELL_COLUMNS = "sheet string, row_id long, column_id int, cell_text string"


def csv_cells(content: bytes, delimiter: str = ",") -> Iterator[tuple]:
    for r, row in enumerate(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace")), delimiter=delimiter), 1):
        yield from (("", r, c, cell) for c, cell in enumerate(row, 1) if cell)


_NS = re.compile(r"\{[^}]*\}")


def _local(tag: str) -> str:
    return _NS.sub("", tag)


def column_number(reference: str) -> int:
    """1 for A1, 28 for AB7."""
    n = 0
    for char in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(char) - 64
    return n


def xlsx_cells(content: bytes) -> Iterator[tuple]:
    """Non-empty cells of all sheets, strings resolved."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in root]
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for _, cell in ElementTree.iterparse(io.BytesIO(z.read(name))):
                if _local(cell.tag) != "c":
                    continue
                value = next((v.text for v in cell.iter() if _local(v.tag) in ("v", "t") and v.text), None)
                if value is not None:
                    text = shared[int(value)] if cell.get("t") == "s" else value
                    yield name.rsplit("/", 1)[-1][:-4], int(re.search("[0-9]+", cell.get("r"))[0]), column_number(cell.get("r")), text


def ods_cells(content: bytes) -> Iterator[tuple]:
    """Non-empty cells of all sheets, repeated ones as often as they stand."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    attribute = lambda e, name: next((v for k, v in e.attrib.items() if _local(k) == name), None)
    for sheet in (e for e in root.iter() if _local(e.tag) == "table"):
        r = 0
        for row in (e for e in sheet.iter() if _local(e.tag) == "table-row"):
            repeat, c = min(int(attribute(row, "number-rows-repeated") or 1), 1000), 0
            cells = []
            for cell in row:
                n = int(attribute(cell, "number-columns-repeated") or 1)
                text = attribute(cell, "date-value") or attribute(cell, "value") or "\n".join("".join(p.itertext()) for p in cell if _local(p.tag) == "p")
                cells += [(c + i + 1, text) for i in range(n) if text]
                c += n
            for _ in range(repeat if cells else 0):
                r += 1
                yield from ((attribute(sheet, "name"), r, column, text) for column, text in cells)
            r += 0 if cells else repeat


def office_text(content: bytes) -> Iterator[tuple[str]]:
    """The text of a word-processing, presentation or book file: its XML parts' paragraphs, in order."""
    parts = re.compile(r"word/document\.xml|ppt/slides/slide\d+\.xml|content\.xml|.*\.x?html")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        lines = []
        for name in sorted(n for n in z.namelist() if parts.fullmatch(n)):
            for p in ElementTree.fromstring(z.read(name)).iter():
                if _local(p.tag) in ("p", "h", "h1", "h2", "h3", "li"):
                    lines.append("".join(t for t in p.itertext()))
        yield ("\n".join(line for line in lines if line.strip()),)


def pages_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """Pages that a form feed parts, numbered from 1."""
    others = [c for c in texts.columns if c != text]
    return texts.select(*others, F.posexplode(F.split(text, "\f")).alias("_p", text)).withColumn("page_id", F.col("_p") + 1).drop("_p")


def as_json_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each row as its key and a JSON object: the raw dump of any table."""
    return df.select(*keys, F.to_json(F.struct("*")).alias("row"))
