"""WARC derivatives: response records become linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_columns, small_batches

RESPONSE = "record_id string, target_uri string, warc_date string, http_headers string, body string, block_digest string, payload_digest string"
DERIVED = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_digest string, source_headers string, n_links int, n_words int, block string"
#: The date of pages that come without one.
NO_DATE = "1970-01-01T00:00:00Z"

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAKS = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|title|blockquote|pre|hr|dd|dt)\b[^>]*>", re.I)
_CELLS = re.compile(r"</?(?:td|th)\b[^>]*>", re.I)
_TAGS = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINKS = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def id_name(id_col: str) -> str:
    """The id's column in records."""
    return f"source_{id_col}" if id_col in {c.split()[0] for c in f"{RESPONSE}, {DERIVED}".split(", ")} else id_col


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A record id that depends on the parts alone, so that reruns link alike."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr(parts).encode()).digest()[:16], version=5)}>"


def plain_text(page: str) -> str:
    """The page's visible text: a line a block, no markup, references decoded, runs of blanks as one."""
    page = _DROPPED.sub(" ", page)
    page = _TAGS.sub("", _CELLS.sub("\t", _BREAKS.sub("\n", page)))
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(page))).strip()


def page_facts(page: str) -> dict:
    """Title, language and links of a page."""
    seen = _DROPPED.sub(" ", page)
    title, lang = _TITLE.search(seen), _LANG.search(seen)
    links = [html.unescape(next((x for x in m if x), "")) for m in _LINKS.findall(seen)]
    return {"title": html.unescape(title[1]).strip() if title else None, "lang": lang[1] if lang else None, "links": links}


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record for each fetched page: id and the columns of RESPONSE.

    A null page has an empty body, a null address an empty target. Record ids depend on id, address and body: rows that repeat
    are the same record. Pages of any length are taken whole; an empty table gives an empty result; other columns are ignored. The id's
    column gets the prefix ``source_`` where its name is that of a record's field.
    """
    small_batches(pages.sparkSession)

    def make():
        def step(batch):
            out = []
            for key, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                body = (page or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                payload = digest(body)
                out.append((record_id("response", key, url, payload), url or "", NO_DATE, head, page or "", digest(head.encode() + body), payload))
            return [batch.column(0), *([x[k] for x in out] for k in range(7))]

        return step

    kind = pages.select(id_col).dtypes[0][1]
    return map_columns(pages.select(id_col, url_col, html_col), make, f"`{id_name(id_col)}` {kind}, {RESPONSE}")


def derive(source: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two records for each response, metadata and conversion: id and the columns of DERIVED.

    ``refers_to`` is the response's record id, ``source_digest`` its payload digest, and target and date are the response's; the
    metadata block (JSON) also holds the response's block digest and its HTTP headers, and so does ``source_headers`` of both. An empty
    or null body gives an empty conversion; rows that repeat are derived each; bodies of any length are taken whole; an empty table gives
    an empty result; other columns are ignored. ``id_col`` is the one that ``responses`` was given.
    """
    id_col = id_name(id_col)
    small_batches(source.sparkSession)

    def make():
        def step(batch):
            ids, out = [], []
            for key, rid, uri, date, head, body, block_digest, payload in zip(*(c.to_pylist() for c in batch.columns)):
                body, rid, uri = body or "", rid or "", uri or ""
                facts, text = page_facts(body), plain_text(body)
                lines = [x.split(": ", 1) for x in (head or "").split("\r\n")[1:] if ": " in x]
                envelope = {"refers-to": rid, "block-digest": block_digest, "payload-digest": payload, "http-status": (head or "").split("\r\n")[0], "http-headers": lines, **facts}
                blocks = (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False)), ("conversion", "text/plain", text))
                for kind, content, block in blocks:
                    raw = block.encode()
                    ids.append(key)
                    out.append((kind, record_id(kind, rid), rid, uri, date, content, len(raw), digest(raw), payload, head, len(facts["links"]), len(text.split()), block))
            return [ids, *([x[k] for x in out] for k in range(13))]

        return step

    kind = source.select(id_col).dtypes[0][1]
    names = [c.split()[0] for c in RESPONSE.split(", ")]
    return map_columns(source.select(id_col, *names), make, f"`{id_col}` {kind}, {DERIVED}")


def record_text(records: DataFrame) -> DataFrame:
    """(record): each derived record in WARC 1.0 form, without the last line end."""
    line = lambda name, column: F.when(F.coalesce(F.col(column).cast("string"), F.lit("")) != "", F.concat(F.lit(name + ": "), F.col(column), F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"),
        line("WARC-Target-URI", "target_uri"), line("WARC-Date", "warc_date"), line("WARC-Block-Digest", "block_digest"),
        line("WARC-Source-Payload-Digest", "source_digest"), line("Content-Type", "content_type"), line("Content-Length", "content_length"),
    )
    return records.select(F.concat(head, F.lit("\r\n"), F.col("block"), F.lit("\r\n")).alias("record"))


def write_records(records: DataFrame, path: str) -> None:
    """Write derived records as gzipped WARC part files."""
    record_text(records).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


VERSION = "WARC/1.0\r\n"
RECORD = "headers map<string,string>, block string, complete boolean"


def parsed(parts: list[str]) -> tuple[list[tuple[str, str]], str, bool] | None:
    """(headers, block, whether the block has the length that the headers state) of a record after its version line; None while its block is too short."""
    head, _, rest = VERSION.join(parts).partition("\r\n\r\n")
    headers = [tuple(x.split(": ", 1)) for x in head.split("\r\n") if ": " in x]
    stated = dict(headers).get("Content-Length", "")
    raw = rest.encode()
    if not stated.isdecimal():
        return headers, rest.removesuffix("\r\n\r\n"), False
    if len(raw) < int(stated):
        return None
    block = raw[: int(stated)].decode(errors="replace")
    return headers, block, len(raw) - int(stated) <= 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(headers: map, block, complete): the records of WARC 1.0 files, as long as their headers state, so a version line within a block ends nothing.

    ``complete`` is false where the length isn't stated or isn't what is there. Compressed files are read by one task each, one record at a time.
    Spark may split a file that isn't compressed: a record is then whole unless a version line stands within its block where the parts meet.
    """
    lines = spark.read.option("lineSep", VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")

    fields = StructType.fromDDL(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, place, held = to_arrow_schema(fields), None, []

        def close() -> list[tuple]:
            if not any(held):
                return []
            head, _, rest = VERSION.join(held).partition("\r\n\r\n")
            return [([tuple(x.split(": ", 1)) for x in head.split("\r\n") if ": " in x], rest.removesuffix("\r\n\r\n"), False)]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], type=f.type) for k, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            out = []
            for file, at, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, at) != place:
                    out += close()
                    place, held = (file, at), []
                held.append(value)
                if any(held) and (found := parsed(held)):
                    out.append(found)
                    held = []
                elif not any(held):
                    held = []
            if out:
                yield batch_of(out)
        if out := close():
            yield batch_of(out)

    return lines.mapInArrow(run, RECORD)
