import os
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from helpers import CLASHING, stored
from locuswise.llm import warc
from locuswise.llm.common import table

PAGE = "<html><head><title>A &amp; B</title><style>x{}</style></head><body><p>One<br>two</p><script>no()</script><a href='/x?a=1&amp;b=2'>link</a></body></html>"


class _Visible(HTMLParser):
    """A plain second reading of pages, by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.hidden = [""], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style", "template")
        if tag in warc.BREAKS and not self.hidden:
            self.lines.append("")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style", "template")
        if tag in warc.BREAKS and not self.hidden:
            self.lines.append("")

    def handle_data(self, data):
        if not self.hidden:
            first, *rest = data.split("\n")
            self.lines[-1] += first
            self.lines += rest


def visible(page):
    parser = _Visible()
    parser.feed(page)
    parser.close()
    return "\n".join(line for line in (" ".join(x.split()) for x in parser.lines) if line)


def test_derivatives_refer_to_their_response():
    response = warc.page_response(3, "http://a.org/x", PAGE)
    metadata, conversion = warc.derived(warc.parse_record(response.encode()))
    for record in (metadata, conversion):
        assert record.get("WARC-Refers-To") == response.get("WARC-Record-ID") and record.get("WARC-Target-URI") == "http://a.org/x"
        assert record.get("WARC-Block-Digest") == warc.digest(record.block) and record.get("Content-Length") == str(len(record.block))
        assert warc.parse_record(record.encode()).block == record.block
    assert conversion.block.decode() == "One\ntwo\nlink"
    notes = metadata.block.decode()
    assert f"source-payload-digest: {warc.digest(PAGE.encode())}\r\n" in notes
    assert "source-header-content-type: text/html; charset=utf-8\r\n" in notes and "outlink: /x?a=1&b=2\r\n" in notes and "title: A & B\r\n" in notes


@pytest.mark.parametrize("packed", [False, True])
def test_files_come_back(spark, tmp_path, packed):
    made = [warc.page_response(i, f"http://a/{i}", PAGE * i).encode() for i in range(5)]
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.warc").write_bytes(b"".join(map(warc.zipped, made)) if packed else b"".join(made))
    read = warc.read_records(spark, str(tmp_path / "in"))
    rows = warc.derivatives(read).collect()
    assert len(rows) == 10 and {r.file.rsplit("/", 1)[1] for r in rows} == {"a.warc"}
    assert all(warc.parse_record(bytes(r.record)).get("WARC-Record-ID") == r.record_id for r in rows)


def test_whole_table(spark, small):
    pages = {r.page_id: r for r in table(spark, small, "pages").collect()}
    rows = warc.query(spark, small).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        page = pages[r.page_id]
        assert r.target_uri == page.url and r.source_payload_digest == warc.digest(page.html.encode())
        if r.warc_type == "conversion":
            assert r.block_digest == warc.digest(visible(page.html).encode())


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, tmp_path, clashing):
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", "<p>x</p>" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    if clashing:
        df = df.withColumns({c: F.lit("mine") for c in [*CLASHING, "record_id", "warc_type"]})
    pages = stored(df, tmp_path)
    records = warc.page_records(pages)
    if clashing:
        records = records.withColumns({c: F.lit("mine") for c in ("record_id", "size")})
    assert warc.derivatives(records).count() == 8
    odd = spark.createDataFrame([(None,), (b"",), (b"no record",), (b"WARC/1.0\r\nWARC-Type: request\r\n\r\n",)], "record binary")
    assert warc.derivatives(odd).count() == 0
    assert warc.derivatives(warc.page_records(stored(df.limit(0), tmp_path))).count() == 0


@pytest.mark.parametrize("unit", ["<head ", "<a ", "<a href=x>", "<title>", "<script>", "<!--", "<div><p>", "<", "</", "<a \"", "<head>x</head>"])
def test_time_grows_with_the_page_only(unit):
    page = unit * (120_000 // len(unit))
    start = time.time()
    warc.derived(warc.page_response(1, "u", page))
    assert time.time() - start < 2


@pytest.mark.parametrize("charset", ["idna", "undefined", "punycode", "base64", "hex", "no-such", "utf-16", "latin-1"])
def test_odd_charsets(charset):
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n<p>one".encode()
    response = warc.Record([("WARC-Type", "response")], block)
    assert (warc.derived(response)[1].block == b"one") == (charset != "utf-16")


def test_line_breaks_do_not_reach_headers():
    page = "<title>a\r\nb&#13;&#10;c</title><a href='x\r\noutlink: y'>l</a><a href='&#10;&#10;z'>"
    for url in ("http://a/\r\n\r\nbody", "u\r\nContent-Length: 3", "\n"):
        response = warc.parse_record(warc.page_response(1, url, page).encode())
        assert response == warc.page_response(1, url, page) and "\n" not in response.get("WARC-Target-URI")
        for record in warc.derived(response):
            assert warc.parse_record(record.encode()) == record
            assert record.get("WARC-Target-URI") == warc.uri_value(url)
        notes = warc.derived(response)[0].block.decode()
        assert notes.count("\r\noutlink: ") == 2 and "outlink: x%0D%0Aoutlink: y\r\n" in notes and "title: a b c\r\n" in notes


@pytest.mark.parametrize("length", ["²", "-1", "", "9" * 5000, "1e3", "٣"])
def test_lengths_that_are_none(length):
    record = warc.parse_record(f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {length}\r\n\r\nabc".encode())
    assert record.block == b"abc"


def test_equal_names_only_for_equal_pages():
    names = {warc.page_response(1, "u", p).get("WARC-Record-ID") for p in ("a", "b", "a", None, "")}
    assert len(names) == 3


@pytest.mark.parametrize("packed", [False, True])
def test_reading_goes_on_after_what_cannot_be_read(spark, tmp_path, packed):
    made = [warc.page_response(i, f"http://a/{i}", PAGE).encode() for i in range(4)]
    no_length = b"WARC/1.0\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\n\r\nx"
    parts = [made[0], b"garbage\r\n", made[1], no_length + b"\r\n\r\n", made[2], made[3][:40]]
    if packed:
        parts = [warc.zipped(made[0]), b"garbage", warc.zipped(made[1]), warc.zipped(no_length), warc.zipped(made[2]), warc.zipped(made[3])[:60]]
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.warc").write_bytes(b"".join(parts))
    rows = warc.read_records(spark, str(tmp_path / "in")).collect()
    assert [bytes(r.record).strip() for r in rows if r.record is not None] == [x.strip() for x in (made[0], made[1], no_length, made[2])]
    assert [r.skipped for r in rows] == ([0, 7, 0, 0, 60] if packed else [0, 7, 0, 0, 40])
    assert warc.derivatives(warc.read_records(spark, str(tmp_path / "in"))).count() == 8
