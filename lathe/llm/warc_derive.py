"""WARC derivatives: conversion and metadata records built from responses.

Every response gives two records. The conversion record holds the page's plain text; the
metadata record holds the source's headers as ``application/warc-fields``, with title,
links and digests. Both refer to the response by id, target and date, carry the source's
payload digest, so a derived file can be traced without the original, and name each other.
Ids are name-based UUIDs of the source id and the kind: a rerun names the same records.

Rows are handled one by one in Arrow batches; nothing is shuffled. A page is read once from
front to back, so hostile markup costs no more than its length.

Defined results: a null payload is empty and gives an empty conversion; a null url, digest
or header gives records without that field; repeated rows give repeated records with the
same ids; extra columns are ignored; an empty table gives no rows. Broken markup: a comment,
script or style that isn't closed hides the rest, and so does a tag without an end; once a
quoted value isn't closed, quotes no longer hide a ``>`` in the rest of that page.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import map_arrow, slices

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derived")
CAPTURE_DATE = "2024-01-01T00:00:00Z"
_OPEN = re.compile(r"<(?:(!--)|([!?]|/(?![a-zA-Z]))|(/?)([a-zA-Z][^\s/>]*))")
_MARK = re.compile(r"""[>"']""")
_HIDDEN = {k: re.compile(rf"</{k}(?=[\s/>])[^>]*>?", re.I) for k in ("script", "style", "noscript", "template", "title")}
_HREF = re.compile(r"""(?:^|[\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that begin and end a line of text.
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul head body html".split())
_SPACES = re.compile(r"[ \t\f\v\xa0]+")
_LINES = re.compile(r" ?[\r\n]\s*")
_ZEROS = re.compile(r"(&#[xX]?)0+(?=[0-9a-fA-F])")
_LARGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")

RESPONSE = "page_id long, record_id string, target_uri string, date string, http_header string, payload string, block_digest string, payload_digest string"
DERIVED = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_payload_digest string, linked_id string, block string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _decoded(text: str) -> str:
    """Entities decoded; a number beyond all characters is the replacement character."""
    if "&" not in text:
        return text
    return html.unescape(_LARGE.sub("\ufffd", _ZEROS.sub(r"\1", text)))


def read_page(page: str) -> tuple[str, str, list[str]]:
    """Visible text (a line for each block, white space folded), title, and distinct link targets in order."""
    out: list[str] = []
    links: dict[str, None] = {}
    title, at, quotes = None, 0, True
    while m := _OPEN.search(page, at):
        out.append(page[at : m.start()])
        comment, other, closing, name = m.groups()
        if comment:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            out.append(" ")
            continue
        end = page.find(">", m.end())
        if quotes and not other and end >= 0:
            here = m.end()
            while (mark := _MARK.search(page, here)) and mark[0] != ">":
                here = page.find(mark[0], mark.end()) + 1
                if not here:
                    break
            quotes = bool(here and mark)
            end = mark.start() if quotes else end
        at = len(page) if end < 0 else end + 1
        if other:
            continue
        name = name.lower()
        if name in _HIDDEN:
            out.append("\n" if name == "title" else " ")
            if not closing:
                last = _HIDDEN[name].search(page, at)
                if name == "title" and title is None:
                    title = page[at : last.start() if last else len(page)]
                at = last.end() if last else len(page)
        elif name in _BLOCKS:
            out.append("\n")
        elif name == "a" and not closing:
            link = _HREF.search(page, m.end(), len(page) if end < 0 else end)
            target = _decoded(link[1] or link[2] or link[3] or "").strip() if link else ""
            if target:
                links[target] = None
    out.append(page[at:])
    text = _LINES.sub("\n", _SPACES.sub(" ", _decoded("".join(out)))).strip()
    return text, _SPACES.sub(" ", _decoded(title or "")).strip().replace("\r", " ").replace("\n", " "), list(links)


def responses(pages: DataFrame, date: str = CAPTURE_DATE) -> DataFrame:
    """Response records (RESPONSE) of a table of page_id, url, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (page or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                rid = uuid.uuid5(NAMESPACE, f"response {page_id} {url} {digest(body)}")
                out.append((page_id, f"<urn:uuid:{rid}>", url, date, head, page or "", digest(head.encode() + body), digest(body)))
            yield _table(out, RESPONSE)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.transform(map_arrow, run, RESPONSE)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    cols = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.record_batch({k: pa.array(c, pa.int64() if t == "long" else pa.string()) for k, t, c in zip(names, kinds, cols, strict=True)})


def derive(records: DataFrame) -> DataFrame:
    """Two derived records (DERIVED) of every response record."""
    names = [f.split()[0] for f in RESPONSE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for page_id, rid, url, date, head, page, block_digest, payload_digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, title, links = read_page(page or "")
                ids = {kind: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {rid}')}>" for kind in ("conversion", "metadata")}
                status, *lines = (head or "").strip("\r\n").split("\r\n")
                fields = [("source-status", status)] + [(f"source-header-{x.partition(':')[0].strip().lower()}", x.partition(":")[2].strip()) for x in lines]
                fields += [("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("title", title), ("conversion-record", ids["conversion"]), ("text-length", len(text)), ("text-digest", digest(text.encode()))]
                fields += [("outlink", x.replace("\r", " ").replace("\n", " ")) for x in links]
                said = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None and v != "")
                for kind, other, content, block in (("conversion", "metadata", "text/plain; charset=utf-8", text), ("metadata", "conversion", "application/warc-fields", said)):
                    data = block.encode()
                    out.append((page_id, kind, ids[kind], rid, url, date, content, len(data), digest(data), payload_digest, ids[other], block))
            yield _table(out, DERIVED)

    return records.select(*names).transform(map_arrow, run, DERIVED)


def serialise(records: DataFrame) -> DataFrame:
    """page_id, record_id, record (binary): derived records as bytes of WARC/1.1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, rids, out = [], [], []
            for page_id, kind, rid, refers, url, date, content, n, block_digest, payload_digest, linked, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("WARC-Block-Digest", block_digest), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Concurrent-To", linked), ("Content-Type", content), ("Content-Length", n)]
                lines = "".join(f"{k}: {' '.join(str(v).splitlines())}\r\n" for k, v in head if v is not None)
                ids.append(page_id)
                rids.append(rid)
                out.append(f"WARC/1.1\r\n{lines}\r\n{block}\r\n\r\n".encode())
            yield pa.record_batch({"page_id": pa.array(ids, pa.int64()), "record_id": pa.array(rids, pa.string()), "record": pa.array(out, pa.binary())})

    return records.select(*(f.split()[0] for f in DERIVED.split(", "))).transform(map_arrow, run, "page_id long, record_id string, record binary")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one serialised record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def write_warc(records: DataFrame, path: str) -> None:
    """One folder of files of concatenated records; Spark's writer commits them."""
    serialise(records).select(F.col("record").cast("string").alias("value")).write.option("lineSep", "").text(path)
