"""Derivatives of web captures: linked metadata and plain-text conversion records.

``responses`` makes response records of pages, ``derive`` makes of every response a metadata
record (title, language, links, the source's headers and digests) and a conversion record (plain
text). Both refer to the response by its id, address, date and payload digest. Ids are made from
the content, so that a repeated task writes the same records. ``write_warc`` writes records as
WARC 1.1 files.

A null address or page is empty and still has both records; repeated rows have equal records.
Tags end at the next angle bracket, so a bracket inside a quoted attribute ends its tag early; an
unclosed comment, script or style hides the rest of the page, as in browsers.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import read

CREATED = "2024-01-01T00:00:00Z"
HTTP_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|title)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
LANGUAGE = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
ANCHOR = re.compile(r"<a\b([^<>]*)>", re.I)
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that stand on lines of their own.
LINES = re.compile(
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^<>]*>",
    re.I,
)
TAG = re.compile(r"<[!/?A-Za-z][^<>]*>?")
BLANKS = re.compile(r"[^\S\n]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def plain_text(page: str) -> str:
    text = TAG.sub("", LINES.sub("\n", HIDDEN.sub(" ", page)))
    lines = (BLANKS.sub(" ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def links(page: str, base: str) -> list[str]:
    """The distinct targets of anchors in order, joined to the address of the page."""
    found = {}
    for anchor in ANCHOR.finditer(HIDDEN.sub(" ", page)):
        if target := HREF.search(anchor[1]):
            target = html.unescape(next(x for x in target.groups() if x is not None)).strip()
            try:
                target = urljoin(base, target)
            except ValueError:
                pass  # kept as it stands
            found[" ".join(target.split())] = None
    return list(found)


def _one_line(text: str) -> str:
    return " ".join(html.unescape(text).split())


def metadata_block(page: str, address: str, headers: str, payload_digest: str) -> tuple[str, int]:
    """Fields as application/warc-fields has them, and the number of links."""
    fields = [("payload-digest", payload_digest)]
    if title := TITLE.search(page):
        fields.append(("title", _one_line(title[1])))
    if language := LANGUAGE.search(page):
        fields.append(("language", language[1]))
    fields += [("source-header", line) for line in headers.split("\r\n")[1:] if line]
    targets = links(page, address)
    fields += [("outlink", target) for target in targets]
    return "".join(f"{name}: {value}\r\n" for name, value in fields), len(targets)


def record(fields: list[tuple[str, str]], block: str) -> str:
    """A WARC record without the two line ends that close it."""
    return "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n" + block


RESPONSE = "page_id {}, record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string, block_digest string"
DERIVED = "page_id {}, warc_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_length bigint, n_links bigint, block string, record string"


def _batch(rows: list[tuple], batch: pa.RecordBatch, ids: list[int], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * (len(names) - 1)
    kinds = [pa.int64() if name in ("content_length", "n_links") else pa.string() for name in names[1:]]
    arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *arrays], names)


def _respond(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, page in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                url, page = _one_line(url or ""), page or ""
                payload = digest(page.encode())
                block = digest(f"{HTTP_HEADERS}\r\n{page}".encode())
                own = record_id("response", str(page_id), url, date, payload)
                rows.append((own, url, date, HTTP_HEADERS, page, payload, block))
            names = ["page_id", "record_id", "target_uri", "date", "http_headers", "payload", "payload_digest", "block_digest"]
            yield _batch(rows, batch, list(range(len(rows))), names)

    return run


def responses(pages: DataFrame, date: str = CREATED) -> DataFrame:
    """Response records of (page_id, url, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_respond(date), RESPONSE.format(kind))


def _derive(created: str):
    def both(source: str, address: str, date: str, headers: str, page: str, payload_digest: str) -> Iterator[tuple]:
        fields, n_links = metadata_block(page, address, headers, payload_digest)
        kinds = [("metadata", "application/warc-fields", fields, n_links), ("conversion", "text/plain; charset=utf-8", plain_text(page), None)]
        for kind, content, block, count in kinds:
            data = block.encode()
            own, own_digest = record_id(kind, source), digest(data)
            head = [
                ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", created), ("WARC-Target-URI", address),
                ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", address), ("WARC-Refers-To-Date", date),
                ("WARC-Block-Digest", own_digest), ("Content-Type", content), ("Content-Length", str(len(data))),
            ]
            yield kind, own, source, address, payload_digest, own_digest, len(data), count, block, record(head, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.strip().split(" ")[0] for part in DERIVED.split(",")]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = [row for source in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True) for row in both(*source)]
                yield _batch(rows, part, [i // 2 for i in range(len(rows))], names)

    return run


def derive(captured: DataFrame, created: str = CREATED) -> DataFrame:
    """Two records per response: metadata, then conversion."""
    kind = captured.schema["page_id"].dataType.simpleString()
    source = captured.select("page_id", "record_id", "target_uri", "date", "http_headers", "payload", "payload_digest")
    return source.mapInArrow(_derive(created), DERIVED.format(kind))


def write_warc(records: DataFrame, folder: str) -> None:
    """Compressed WARC files, one per task."""
    records.select("record").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)


def op2_warc_derivatives(spark, folder: str) -> DataFrame:
    found = derive(responses(read(spark, folder, "pages")))
    return found.select(*[F.col(name) for name in found.columns if name != "record"])
