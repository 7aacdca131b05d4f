"""WARC derivatives: metadata and plain-text conversion records of responses, linked to them by identifier."""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 256
BREAKS = frozenset(
    "address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
)
RAW = {tag: re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE) for tag in ("script", "style", "template")}
_MARK = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
_HREF = re.compile(r"\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_HEAD_ENDS = re.compile(r"</head\b|<body\b", re.IGNORECASE)
_TITLE_ENDS = re.compile(r"</title\b", re.IGNORECASE)
#: Names of codecs that are no charsets of pages.
NO_CHARSETS = frozenset("idna punycode undefined unicode-escape unicode_escape raw-unicode-escape raw_unicode_escape".split())
_CONTROLS = re.compile(r"[\x00-\x1f\x7f]")


class Record(NamedTuple):
    """A record: its header fields in order, names as written, and its block."""

    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def encode(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers)
        return f"WARC/1.0\r\n{head}\r\n".encode() + self.block + b"\r\n\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_name(*parts: str) -> str:
    """A record identifier that follows from its parts, so a task run again writes the same records."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(chr(0).join(parts).encode()).digest())}>"


def _fields(lines: bytes) -> list[tuple[str, str]]:
    found: list[tuple[str, str]] = []
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            found.append((name.strip(), value.strip()))
    return found


def _length(headers: list[tuple[str, str]]) -> int | None:
    """The stated length of a block; None if there is none that can be read."""
    value = next((v for k, v in headers if k.lower() == "content-length"), "")
    return int(value) if value.isascii() and value.isdigit() and len(value) < 19 else None


def parse_record(data: bytes) -> Record | None:
    """The record at the start of ``data``; None if it is none. A missing or unreadable length takes the rest."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not found:
        return None
    headers = _fields(head.partition(b"\r\n")[2])
    return Record(headers, rest[: _length(headers)])


def _plain_records(data: bytes) -> Iterator[tuple[bytes | None, int]]:
    at = skipped = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/", at) else -1
        if end < 0:
            # not a record: go on at the next line that opens one
            following = data.find(b"\nWARC/", at)
            following = len(data) if following < 0 else following + 1
            skipped += len(data[at:following].strip(b"\r\n"))
            at = following
            continue
        length = _length(_fields(data[at:end].partition(b"\r\n")[2]))
        if length is None:
            following = data.find(b"\r\n\r\nWARC/", end + 4)
            stop = len(data) if following < 0 else following
        else:
            stop = min(len(data), end + 4 + length)
        yield data[at:stop], skipped
        skipped, at = 0, stop
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
    if skipped:
        yield None, skipped


def split_records(data: bytes) -> Iterator[tuple[bytes | None, int]]:
    """(record, skipped) of a file's bytes, one by one; gzip members are opened one at a time.

    What can't be read is passed over up to the next record or member; ``skipped`` counts the bytes passed over before
    a record. Bytes passed over at the end come with no record.
    """
    if not data.startswith(b"\x1f\x8b"):
        yield from _plain_records(data)
        return
    at = skipped = 0
    while at < len(data):
        opened = zlib.decompressobj(31)
        try:
            part = opened.decompress(memoryview(data)[at:]) if data.startswith(b"\x1f\x8b", at) else None
        except zlib.error:
            part = None
        if part is None or not opened.eof:
            following = data.find(b"\x1f\x8b\x08", at + 1)
            following = len(data) if following < 0 else following
            skipped += following - at
            at = following
            continue
        at = len(data) - len(opened.unused_data)
        for record, more in _plain_records(part):
            yield record, skipped + more
            skipped = 0
    if skipped:
        yield None, skipped


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields and payload of an HTTP response; a block without a head is all payload."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    line, _, fields = head.partition(b"\r\n")
    return line.decode("latin-1"), _fields(fields), payload


class Page(NamedTuple):
    text: str
    title: str | None
    links: list[str]


def read_page(page: str) -> Page:
    """Visible text (a line per block), title and link targets of a page, from one pass over its tags.

    References are decoded and white space is made plain. The head, scripts, styles, templates and comments are no text.
    """
    text: list[str] = []
    links: list[str] = []
    title, in_head, at, closed = None, False, 0, page.rfind(">")
    head_end, title_end = (max((m.start() for m in ends.finditer(page)), default=-1) for ends in (_HEAD_ENDS, _TITLE_ENDS))
    while at < len(page):
        mark = _MARK.search(page, at) if at <= closed or page.find("<!--", at) >= 0 else None
        stop = mark.start() if mark else len(page)
        if not in_head:
            text.append(page[at:stop])
        if not mark:
            break
        at = mark.end()
        if not mark[2]:
            text.append(" " if mark[0].startswith("<!--") else "")
            continue
        tag, closing = mark[2].lower(), bool(mark[1])
        if tag == "head":
            in_head = not closing and at < head_end
        elif tag == "body":
            in_head = False
        if tag in BREAKS and not in_head:
            text.append("\n")
        if closing:
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            text.append(" ")
        elif tag == "title" and title is None and at <= title_end:
            end = _TITLE_ENDS.search(page, at)
            title = " ".join(html.unescape(page[at : end.start()]).split())
        elif tag == "a" and (target := _HREF.search(mark[3])):
            links.append(html.unescape(target[1].strip("\"'")))
    lines = (" ".join(line.split()) for line in html.unescape("".join(text)).split("\n"))
    return Page("\n".join(line for line in lines if line), title, links)


def _charset(fields: list[tuple[str, str]]) -> str:
    """The charset that a response names if text can be read in it, else UTF-8."""
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    named = re.search(r"charset=\"?([\w-]+)", kind)
    try:
        codec = codecs.lookup(named[1] if named else "utf-8").name
        b"a\xff\x00".decode(codec, "replace")
    except (LookupError, ValueError):
        return "utf-8"
    return "utf-8" if codec in NO_CHARSETS else codec


def uri_value(uri: str) -> str:
    """A target as a header can hold it: control characters (line breaks too) are percent-encoded."""
    return _CONTROLS.sub(lambda m: f"%{ord(m[0]):02X}", uri)


def _line(value: str) -> str:
    return _CONTROLS.sub(" ", value)


def derived(response: Record) -> list[Record]:
    """The metadata and the conversion record of a response.

    Both refer to the response's identifier and keep its target and date; the metadata record carries the source's
    status, headers and digests, and the title and links of its page. Digests that the source lacks are computed.
    """
    status, fields, payload = http_parts(response.block)
    page = read_page(payload.decode(_charset(fields), "replace"))
    source = response.get("WARC-Record-ID") or record_name("response", response.get("WARC-Target-URI") or "", digest(response.block))
    payload_digest = response.get("WARC-Payload-Digest") or digest(payload)
    block_digest = response.get("WARC-Block-Digest") or digest(response.block)
    notes = [("source-status", _line(status)), *((f"source-header-{_line(k).lower()}", _line(v)) for k, v in fields)]
    notes += [("source-payload-digest", payload_digest), ("source-block-digest", block_digest)]
    notes += [("title", _line(page.title))] if page.title is not None else []
    notes += [("outlink", uri_value(link)) for link in page.links]
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in notes).encode("utf-8", "replace")),
        "conversion": ("text/plain; charset=utf-8", page.text.encode("utf-8", "replace")),
    }
    out = []
    for kind, (content, block) in blocks.items():
        headers = [("WARC-Type", kind), ("WARC-Record-ID", record_name(kind, source)), ("WARC-Refers-To", source)]
        headers += [(n, uri_value(response.get(n))) for n in ("WARC-Target-URI", "WARC-Date") if response.get(n)]
        headers += [("WARC-Block-Digest", digest(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
        out.append(Record(headers, block))
    return out


def page_response(page_id: int | None, url: str | None, page: str | None) -> Record:
    """A response record of a stored page; a null url or page counts as empty. Pages that differ have different names."""
    payload = (page or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    name = record_name("page", str(page_id), url or "", digest(payload))
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Target-URI", uri_value(url or "")), ("WARC-Date", "2024-01-01T00:00:00Z")]
    headers += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))]
    return Record([*headers, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))], block)


def _page_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html")), strict=True)
        yield pa.record_batch({"page_id": batch["page_id"], "record": pa.array([page_response(*r).encode() for r in rows], pa.binary())})


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, record): each row of ``pages`` as the bytes of a response record."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(_page_records, "page_id long, record binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, skipped): the records of WARC files, plain or gzip with a member per record.

    ``skipped`` counts the bytes before a record that could not be read. A file is one value of a task, so it has to be
    below 2 GB (writers of such files commonly cut them at 1 GB).
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                for record, skipped in split_records(content.as_py()):
                    columns = [pa.array([file.as_py()]), pa.array([record], pa.binary()), pa.array([skipped], pa.int64())]
                    yield pa.record_batch(columns, ["file", "record", "skipped"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(split, "file string, record binary, skipped long")


def zipped(record: bytes) -> bytes:
    """A record as a gzip member of its own; members laid end to end are a WARC file."""
    return gzip.compress(record, 6, mtime=0)


_COLUMNS = "warc_type string, record_id string, refers_to string, target_uri string, source_status string, source_headers string, source_payload_digest string, block_digest string, n_links long, content_length long"


def _derivatives(keep_records: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _COLUMNS.split(", ")]
        for batch in batches:
            others = [c for c in batch.schema.names if c != "record"]
            out: list[list] = []
            for row in batch.to_pylist():
                response = parse_record(row["record"] or b"")
                if response is None or response.get("WARC-Type") != "response":
                    continue
                status, fields, payload = http_parts(response.block)
                made = derived(response)
                links = made[0].block.count(b"\r\noutlink: ")
                for one in made:
                    values = [one.get("WARC-Type"), one.get("WARC-Record-ID"), one.get("WARC-Refers-To"), one.get("WARC-Target-URI"), status]
                    values += ["\n".join(f"{k}: {v}" for k, v in fields), response.get("WARC-Payload-Digest") or digest(payload)]
                    values += [one.get("WARC-Block-Digest"), links, len(one.block)]
                    out.append([*(row[c] for c in others), *values, *([one.encode()] if keep_records else [])])
            kinds = [batch.schema.field(c).type for c in others] + [pa.int64() if n in ("n_links", "content_length") else pa.string() for n in names]
            kinds += [pa.binary()] if keep_records else []
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*others, *names, *(["record"] if keep_records else [])])

    return run


def derivatives(records: DataFrame, keep_records: bool = True) -> DataFrame:
    """Two rows per response of ``records`` (record and any other columns): its metadata and its conversion record.

    Rows without a readable response record (null, empty, another type) give nothing. Other columns are carried along,
    unless their names are those of the result. Repeated records give repeated rows with equal identifiers. With
    ``keep_records``, column record has the bytes of the new record, ready to be written. An empty table gives none.
    """
    mine = {c.split()[0] for c in _COLUMNS.split(", ")}
    kept = records.select(*[c for c in records.columns if c not in mine])
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "record")
    schema = ", ".join(filter(None, [others, _COLUMNS, "record binary" if keep_records else ""]))
    return kept.mapInArrow(_derivatives(keep_records), schema)


def query(spark, sf_dir):
    from locuswise.llm.common import table

    return derivatives(page_records(table(spark, sf_dir, "pages")), keep_records=False)
