"""WARC archives: pages written as records, records read back and assembled into captures.

A capture is a request, a response (or a revisit that refers to one) and metadata, separate records
that name each other in WARC-Concurrent-To. Writing and assembling are DataFrame operations:
Spark's text writer ends each record with the two line breaks that WARC asks for, so files are
committed like any other output and a task that is run again leaves none behind. Only the
parser of the files is Python, a file at a time and in pieces of it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_folder, new_folder, ship_package, stored

#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 1000
#: Records of an archive file at most; the input of a write task is the other bound.
FILE_RECORDS = 60_000
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the format.
LINE = "\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit", "resource")

_PIECE = 1 << 20


def _identity(*columns: Column) -> Column:
    """A hash of values that tells null from every string."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns])), 256)


def _urn(*parts: Column) -> Column:
    """A record id that follows from the given values."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    cuts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _header(*fields: tuple[str, Column]) -> Column:
    """Header lines and the empty line behind them; a field without a value is left out."""
    lines = [
        F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), value, F.lit(LINE)))
        for name, value in fields
    ]
    return F.concat(F.lit(VERSION + LINE), F.concat_ws("", *lines), F.lit(LINE))


def _record(block: Column, *fields: tuple[str, Column]) -> Column:
    length = F.octet_length(block).cast("string")
    return F.concat(_header(*fields, ("Content-Length", length)), block)


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, copy, row, payload): every row, told apart by (row, copy).

    ``row`` hashes the row's values. Of rows that repeat all values one is kept with their
    number before they are dealt out again, so ids do not depend on partitions or retries.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select(
        "*", _identity(F.col("page_id"), F.col("url"), F.sha2("html", 256)).alias("row")
    )
    counts = rows.groupBy("row").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    repeated = stored(counts, "warc-repeated")
    twice = rows.join(repeated, "row").groupBy("row", "copies").agg(
        F.max(F.struct("page_id", "url", "html")).alias("r")
    ).select(
        "r.*", "row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    )
    once = rows.join(repeated, "row", "left_anti").withColumn("copy", F.lit(1))
    return once.unionByName(twice).withColumn("payload", F.sha2("html", 256))


def originals(rows: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(payload, original): the row with the largest page_id of each payload met repeatedly."""
    long = rows.where(F.octet_length("html") >= least_bytes)
    best = F.max(F.struct("page_id", "row", "copy", "url")).alias("original")
    return long.groupBy("payload").agg(best, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def warc_records(pages: DataFrame, least_bytes: int = REVISIT_BYTES, date: str = DATE) -> DataFrame:
    """(value): the request, the response or revisit and the metadata record of every page.

    Payloads are equal if their SHA-256 is. Of those with ``least_bytes`` bytes or more the row
    with the largest page_id (null is smallest; of repeated rows the last copy) is the response
    and all others are revisits. A null html is an empty payload, a null or empty url gives
    no target URI; the metadata block keeps the exact url and page_id as JSON. Other columns are
    ignored; an empty table gives no records.
    """
    rows = page_rows(pages)
    known = stored(originals(rows, least_bytes), "warc-originals")
    o = F.col("original")
    named = rows.join(known, "payload", "left").withColumn(
        "refers", o.isNotNull() & ~((o["row"] == F.col("row")) & (o["copy"] == F.col("copy")))
    )
    copy = F.col("copy").cast("string")
    uri = lambda url: F.regexp_replace(F.coalesce(url, F.lit("")), "[\\x00-\\x20\\x7F]", "%20")
    capture, when = _urn(F.col("row"), copy, F.lit("capture")), F.lit(date)
    common = [("WARC-Date", when), ("WARC-Target-URI", uri(F.col("url")))]
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.octet_length("html").cast("string"), F.lit(LINE * 2),
    )
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("html").cast("binary"))))
    kind = ("Content-Type", F.lit("application/http;msgtype=response"))
    response = _record(
        F.concat(head, F.col("html")), ("WARC-Type", F.lit("response")), ("WARC-Record-ID", capture),
        *common, digest, kind,
    )
    revisit = _record(
        head, ("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", capture), *common, digest,
        ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Refers-To", _urn(o["row"], o["copy"].cast("string"), F.lit("capture"))),
        ("WARC-Refers-To-Target-URI", uri(o["url"])), ("WARC-Refers-To-Date", when), kind,
    )
    path = F.regexp_extract(uri(F.col("url")), "^[a-zA-Z]+://[^/]*(/[^#]*)", 1)
    request = _record(
        F.concat(
            F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(f" HTTP/1.1{LINE}Host: "),
            F.regexp_extract(uri(F.col("url")), "^[a-zA-Z]+://([^/?#]*)", 1), F.lit(LINE * 2),
        ),
        ("WARC-Type", F.lit("request")),
        ("WARC-Record-ID", _urn(F.col("row"), copy, F.lit("request"))),
        ("WARC-Concurrent-To", capture), *common,
        ("Content-Type", F.lit("application/http;msgtype=request")),
    )
    # A url may hold line breaks, which JSON writes as escapes.
    metadata = _record(
        F.to_json(F.struct("page_id", "url")),
        ("WARC-Type", F.lit("metadata")),
        ("WARC-Record-ID", _urn(F.col("row"), copy, F.lit("metadata"))),
        ("WARC-Concurrent-To", capture), *common, ("Content-Type", F.lit("application/json")),
    )
    three = F.array(request, F.when(F.col("refers"), revisit).otherwise(response), metadata)
    return named.select(F.explode(three).alias("value"))


def write_warc(records: DataFrame, folder: str, file_records: int = FILE_RECORDS) -> None:
    """Archives in ``folder``: gzip files of records, each ended by two line breaks."""
    (
        records.write.option("lineSep", LINE * 2).option("compression", "gzip")
        .option("maxRecordsPerFile", file_records).text(folder)
    )


class _Stream:
    """Bytes of an archive, gzip members of any number or none, by pieces."""

    def __init__(self, content: bytes):
        self.pieces, self.held, self.at = self._pieces(memoryview(content)), b"", 0

    @staticmethod
    def _pieces(content: memoryview) -> Iterator[bytes]:
        if bytes(content[:2]) != b"\x1f\x8b":
            for at in range(0, len(content), _PIECE):
                yield bytes(content[at : at + _PIECE])
            return
        at = 0
        while at < len(content):
            member = zlib.decompressobj(31)
            while not member.eof:
                if at >= len(content):
                    raise ValueError("a gzip member ends early")
                piece = content[at : at + (_PIECE >> 2)]
                at += len(piece)
                yield member.decompress(piece)
            at -= len(member.unused_data)

    def _more(self) -> bool:
        for piece in self.pieces:
            self.held, self.at = self.held[self.at :] + piece, 0
            return True
        return False

    def header(self) -> bytes | None:
        """Up to the next empty line; None at the end of the archive."""
        while True:
            while self.held[self.at : self.at + 1] in (b"\r", b"\n"):
                self.at += 1
            end = self.held.find(b"\r\n\r\n", self.at)
            if end >= 0:
                head, self.at = self.held[self.at : end], end + 4
                return head
            if not self._more():
                if self.at < len(self.held):
                    raise ValueError("an archive ends within a header")
                return None

    def take(self, n: int) -> bytes:
        parts, need = [], n
        while True:
            part = self.held[self.at : self.at + need]
            parts.append(part)
            self.at += len(part)
            need -= len(part)
            if not need:
                return b"".join(parts)
            self.held, self.at = next(self.pieces, None), 0
            if self.held is None:
                raise ValueError("an archive ends within a record")


def _fields(head: bytes) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in head.decode("utf-8", "replace").split(LINE)[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), []).append(value.strip())
    return out


def _hex_digest(value: str | None) -> str | None:
    """SHA-1 of a header field, written in base 32 or 16, as lower-case hex."""
    algorithm, _, digest = (value or "").partition(":")
    if algorithm.lower() != "sha1":
        return None
    if len(digest) == 32:
        return base64.b32decode(digest.upper()).hex()
    return digest.lower()


def parse_archive(content: bytes, payloads: bool) -> Iterator[tuple]:
    """The records of one archive file, as rows of ``RECORDS``."""
    stream = _Stream(content)
    while (head := stream.header()) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {head[:40]!r}")
        field = _fields(head)
        one = lambda name: field.get(name, [None])[0]  # noqa: E731, B023
        block = stream.take(int(one("content-length")))
        kind, stated = (one("warc-type") or "").lower(), _hex_digest(one("warc-payload-digest"))
        length = digest = payload = text = None
        if kind in ("response", "revisit") and (one("content-type") or "").startswith("application/http"):
            top, _, body = block.partition(b"\r\n\r\n")
            if kind == "response":
                length, digest, payload = len(body), hashlib.sha1(body).hexdigest(), body
            else:
                told = _fields(top).get("content-length", [None])[0]
                length, digest = (int(told) if told else None), stated
        elif kind in ("response", "resource"):
            length, digest, payload = len(block), hashlib.sha1(block).hexdigest(), block
        else:
            text = block.decode("utf-8", "replace")
        yield (
            kind, one("warc-record-id"), field.get("warc-concurrent-to", []), one("warc-refers-to"),
            one("warc-target-uri"), one("warc-date"), length, digest,
            None if stated is None or digest is None else stated == digest,
            text, payload if payloads else None,
        )


RECORDS = (
    "kind string, record_id string, concurrent_to array<string>, refers_to string, uri string, "
    "date string, payload_bytes long, payload_digest string, intact boolean, block string, "
    "payload binary"
)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives in ``folder``, gzip or plain.

    Lengths and digests of responses come from their payload, those of revisits from the
    headers; ``intact`` says whether the stated digest is the payload's. ``block`` is the
    text of other records. An archive that ends early or holds something else stops the job.
    A file is read whole by one task, which limits its size to that of a binary value (2 GB).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for row in parse_archive(content, payloads):
                    rows.append(row)
                    held += len(row[-1] or b"") + len(row[-2] or "")
                    if len(rows) >= 5000 or held > 8 * _PIECE:
                        yield _frame(rows, names)
                        rows, held = [], 0
                yield _frame(rows, names)

    # Files that hold nothing have no records either.
    return files.where("length > 0").select("content").mapInPandas(parse, RECORDS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64", "intact": "boolean"})


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its own columns, ``request`` and ``metadata``.

    A record belongs to the capture that it names in WARC-Concurrent-To, that names it, or that
    is so linked with a record that it names. ``request`` is null without one (of several the one
    with the smallest id), ``metadata`` an array ordered by id, empty without any; a
    record met twice counts once there. Records that reach no capture, and kinds that are no
    part of one, are left out.
    """
    capture = F.col("kind").isin(*CAPTURES)
    captures = records.where(capture)
    others = records.where(F.col("kind").isin("request", "metadata"))
    links = others.select(
        F.col("record_id").alias("other"), F.explode("concurrent_to").alias("named")
    ).union(captures.select(F.explode("concurrent_to"), F.col("record_id")))
    through = links.select("other", F.col("named").alias("middle")).join(
        links.select(F.col("other").alias("middle"), "named"), "middle"
    ).select("other", "named")
    links = links.union(through).where("other != named").distinct()
    content = others.select(
        F.col("record_id").alias("other"), "kind", F.struct("record_id", "uri", "date", "block").alias("r")
    )
    parts = links.join(content, "other").groupBy("named").agg(
        F.min(F.when(F.col("kind") == "request", F.col("r"))).alias("request"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "metadata", F.col("r")))).alias("metadata"),
    )
    joined = captures.drop("concurrent_to", "block").join(
        parts, F.col("record_id") == F.col("named"), "left"
    ).drop("named")
    none = F.expr("array()").cast(parts.schema["metadata"].dataType)
    return joined.withColumn("metadata", F.coalesce("metadata", none))


def page_captures(records: DataFrame, page_type: str = "long") -> DataFrame:
    """``assemble`` with the page_id kept in the metadata and that of the response referred to.

    A revisit whose response is in no archive has a null ``refers_page``.
    """
    page = F.get_json_object(F.get(F.col("metadata"), 0)["block"], "$.page_id").cast(page_type)
    captures = stored(assemble(records).withColumn("page_id", page), "warc-captures")
    known = captures.where("kind != 'revisit'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_page")
    )
    again = captures.where("kind = 'revisit'").join(known, "refers_to", "left")
    first = captures.where("kind != 'revisit'").withColumn("refers_page", F.lit(None).cast(page_type))
    return first.unionByName(again)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_folder(spark, "warc")
    write_warc(warc_records(pages), folder)
    records = stored(read_warc(spark, folder, payloads=False), "warc-records")
    drop_folder(spark, folder)
    captures = page_captures(records, pages.schema["page_id"].dataType.simpleString())
    return captures.select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
        F.col("refers_page").alias("refers_to"),
    )


#: The same rows from the table alone, without archives.
OP11_SQL = """
WITH paid AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, octet_length(encode(coalesce(html, ''))) AS n
  FROM pages
), best AS (
  SELECT payload, max(page_id) AS original FROM paid WHERE n >= 1000 GROUP BY payload
)
SELECT p.page_id, n::BIGINT AS payload_bytes, sha1(p.payload) AS payload_digest,
  CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM paid p LEFT JOIN best b ON n >= 1000 AND p.payload = b.payload
"""
