"""Pages and chunks of texts, by bytes of their UTF-8 form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

PAGE_BYTES, CHUNK_BYTES, OVERLAP = 256 * 1024, 1200, 200


def page_bounds(data: bytes, most: int = PAGE_BYTES) -> list[tuple[int, int]]:
    """(start, end) of pages of at most `most` bytes that never part a character."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + most)
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append((at, end))
        at = end
    return out


def chunk_bounds(data: bytes, most: int = CHUNK_BYTES, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most `most` bytes that end at white space where they can, each
    after the first beginning about `overlap` bytes before the end of the last, always further on."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + most)
        if end < len(data):
            cut = max(data.rfind(b" ", at + most // 2, end), data.rfind(b"\n", at + most // 2, end))
            end = cut + 1 if cut > 0 else end
            while end > at + 1 and data[end] & 0xC0 == 0x80:
                end -= 1
        out.append((at, end))
        if end >= len(data):
            break
        back = max(at + 1, end - overlap)
        space = data.find(b" ", back, end)
        at = space + 1 if 0 <= space < end - 1 else back
        while at < end and data[at] & 0xC0 == 0x80:
            at += 1
    return out


def cut_texts(df: DataFrame, bounds, **limits: int) -> DataFrame:
    """(doc_id, part from 1, start, end, text) of every row's text; null and empty texts have no parts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                data = (text or "").encode()
                rows += [(doc, i, a, b, data[a:b].decode()) for i, (a, b) in enumerate(bounds(data, **limits), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "start", "end", "text"])

    return df.select("doc_id", "text").mapInPandas(run, "doc_id long, part long, start long, end long, text string")
