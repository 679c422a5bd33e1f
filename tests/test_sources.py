from __future__ import annotations

import io
import tarfile
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.operators import chunking
from docquarry.operators import search as S
from docquarry.sources import files


def test_scan_hashes_and_archives(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"hello")
    with zipfile.ZipFile(tmp_path / "in/deep/b.zip", "w") as z:
        z.writestr("x/y.txt", "inner")
    with tarfile.open(tmp_path / "in/c.tar", "w") as t:
        info = tarfile.TarInfo("n.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "in/bad.zip").write_bytes(b"PKnope")
    found = files.digests(files.scan_folder(spark, str(tmp_path / "in")))
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in found.collect()}
    assert rows["a.txt"]["md5"] == "5d41402abc4b2a76b9719d911017c592"
    assert rows["a.txt"]["sha3_256"] == "3338be694f50c5f338814986cdf0686453a888b84f424d792af4b9202398f392"
    members = files.unfold(files.scan_folder(spark, str(tmp_path / "in"), "*.{zip,tar}"), files.archive_members, files.ARCHIVE_COLUMNS).collect()
    assert {(r["member"], bytes(r["data"])) for r in members if r["error"] is None} == {("x/y.txt", b"inner"), ("n.txt", b"abc")}
    assert sum(r["error"] is not None for r in members) == 1


def test_mail(spark, tmp_path):
    raw = b"From: Ann <ANN@x.org>\r\nTo: bob@y.org, Cyd <c@z.org>\r\nSubject: Re: Plan\r\nMessage-ID: <1@x>\r\nIn-Reply-To: <0@x>\r\nDate: Thu, 01 Jan 1970 00:01:00 +0000\r\n\r\nBody\r\n"
    (tmp_path / "m.eml").write_bytes(raw)
    row = files.unfold(files.scan_folder(spark, str(tmp_path), "*.eml"), files.mail_rows, files.MAIL_COLUMNS).first()
    assert (row["message_id"], row["subject"], row["date_s"], row["refs"]) == ("<1@x>", "Re: Plan", 60, "<0@x>")
    assert row["addresses"] == ["from:ann@x.org", "to:bob@y.org", "to:c@z.org"] and row["body"].strip() == "Body"


def test_spreadsheets():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst xmlns='u'><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet xmlns='u'><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='AB1' t='s'><v>1</v></c></row><row r='2'><c r='A2'><v>4.5</v></c></row></sheetData></worksheet>")
    assert list(files.xlsx_cells(out.getvalue())) == [("sheet1", 1, 1, "name"), ("sheet1", 1, 28, "ab"), ("sheet1", 2, 1, "4.5")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", "<d xmlns:t='t' xmlns:x='x' xmlns:o='o'><t:table t:name='S'><t:table-row><t:table-cell t:number-columns-repeated='2'><x:p>q</x:p></t:table-cell></t:table-row><t:table-row t:number-rows-repeated='3'/><t:table-row><t:table-cell o:value='7'><x:p>7.00</x:p></t:table-cell></t:table-row></t:table></d>")
    assert list(files.ods_cells(out.getvalue())) == [("S", 1, 1, "q"), ("S", 1, 2, "q"), ("S", 5, 1, "7")]
    assert list(files.csv_cells(b"a,,c\n1,2,3")) == [("", 1, 1, "a"), ("", 1, 3, "c"), ("", 2, 1, "1"), ("", 2, 2, "2"), ("", 2, 3, "3")]


def test_office_text():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:d xmlns:w='w'><w:p><w:t>one </w:t><w:t>two</w:t></w:p><w:p/><w:p><w:t>three</w:t></w:p></w:d>")
    assert list(files.office_text(out.getvalue())) == [("one two\nthree",)]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400), st.integers(4, 40))
def test_pages_never_part_characters(text, most):
    data = text.encode()
    parts = chunking.page_bounds(data, most)
    assert b"".join(data[a:b] for a, b in parts) == data and all(0 < b - a <= most for a, b in parts)
    assert "".join(data[a:b].decode() for a, b in parts) == text


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=600), st.integers(20, 60))
def test_chunks_cover_and_move_on(text, most):
    data = text.encode()
    parts = chunking.chunk_bounds(data, most, most // 5)
    end = 0
    for a, b in parts:
        assert a <= end and b > end and b - a <= most
        data[a:b].decode()
        end = b
    assert end == len(data)


@settings(max_examples=60, deadline=None)
@given(st.integers(-(10**9), 10**9), st.integers(1, 10**9))
def test_histogram_tiles(start, span):
    edges = S.histogram_edges(start, start + span, (start + span // 2,))
    assert edges == sorted(set(edges)) and edges[0] <= start and edges[-1] >= start + span and len(edges) <= 31
