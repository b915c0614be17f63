"""WARC archives: what is written is valid and read back whole, however records name each other."""

import base64
import gzip
import hashlib
import random
from collections import Counter

import pytest

import __spark_entry__ as entry_point
from fleetveil.llm import warc
from fleetveil.llm.common import new_folder

PAGES = "page_id long, url string, html string, record_id string, payload string, row string"
BIG = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n</p>" * 40


def plain(rows):
    """The contract by simple loops, over (page_id, url, html)."""
    best = {}
    key = lambda i: (i is not None, i or 0)
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000:
            best[p] = max(best.get(p, (False, 0)), key(i))
    out = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        first = p not in best or best[p] == key(i)
        to = None if first else best[p][1]
        out[i, len(p), hashlib.sha1(p).hexdigest(), "response" if first else "revisit", to] += 1
    return out


def through_archives(spark, pages, payloads=False):
    folder = new_folder(spark, "warc-test")
    warc.write_warc(warc.warc_records(pages), folder, 7)
    return warc.read_warc(spark, folder, payloads)


def test_op11_equals_brute_force(spark, small):
    rows = entry_point.queries()["op11_warc"](spark, small).collect()
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    assert got == plain(pages)


def test_copies_of_payloads_are_revisits(spark):
    rng = random.Random(3)
    bodies = ["x" * 1000, "y" * 999, "é" * 500, "é" * 499 + "a", BIG, "", None, "z" * 5000]
    rows = [(i, f"http://h/{i % 7}", rng.choice(bodies)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = warc.page_captures(through_archives(spark, pages).checkpoint()).collect()
    assert Counter(
        (r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_page) for r in got
    ) == plain(rows)
    assert all(r.intact for r in got) and all(r.request and len(r.metadata) == 1 for r in got)
    assert len({r.record_id for r in got}) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert all(r.refers_to == by_id[r.refers_page].record_id for r in got if r.kind == "revisit")


def test_odd_pages(spark):
    rows = [
        (None, None, None, "a", "b", "c"), (1, "", "", None, None, None), (None, "http://a b\r\nc/d e", BIG, "", "", ""),
        (2, "http://h", BIG, "", "", ""), (2, "http://h", BIG, "", "", ""), (2, "http://h", BIG, "", "", ""),
        (3, "no url", "\r\n\r\n" * 400, "", "", ""), (4, "ü://x?ü", "w" * 3_000_000, "", "", ""),
        (5, "http://h", "short", "", "", ""), (5, "http://h", "short", "", "", ""), (None, None, None, "", "", ""),
    ]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    records = through_archives(spark, pages, payloads=True).checkpoint()
    assert Counter(r.kind for r in records.select("kind").collect()) == Counter(
        request=11, metadata=11, response=8, revisit=3
    )
    got = warc.page_captures(records).collect()
    kept = Counter((r.page_id, bytes(r.payload)) for r in got if r.kind == "response")
    want = Counter((i, (h or "").encode()) for i, _, h, *_ in rows)
    assert kept == Counter({k: n if k[1] != BIG.encode() else 1 for k, n in want.items() if k != (None, BIG.encode())})
    # Of repeated rows with the largest id one is the response, the others refer to its id too.
    assert sorted((r.page_id or 0, r.refers_page) for r in got if r.kind == "revisit") == [(0, 2), (2, 2), (2, 2)]
    urls = {r.metadata[0].block for r in got}
    assert '{"url":"http://a b\\r\\nc/d e"}' in urls
    assert warc.page_captures(through_archives(spark, pages.limit(0))).count() == 0


def record(kind, name, block=b"", digest=None, **fields):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{name}>", f"Content-Length: {len(block)}"]
    head += [f"WARC-{k.replace('_', '-').title()}: {x}" for k, v in fields.items() for x in ([v] if isinstance(v, str) else v)]
    if kind in ("request", "response", "revisit"):
        head.append(f"Content-Type: application/http; msgtype={kind}")
    if digest:
        head.append(f"WARC-Payload-Digest: {digest}")
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parsed(spark, content):
    rows = list(warc.parse_archive(content, True))
    return spark.createDataFrame(rows, warc.RECORDS)


@pytest.mark.parametrize("packed", ["plain", "members", "whole"])
def test_archives_of_other_writers(spark, packed):
    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nbody\r\n\r\nWARC/1.0\r\n"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"body\r\n\r\nWARC/1.0\r\n").digest()).decode()
    parts = [
        record("warcinfo", "w", b"software: x"),
        # The response names its request, metadata names the request.
        record("response", "a", body, digest, concurrent_to="<urn:ra>"),
        record("request", "ra", b"GET / HTTP/1.1\r\n\r\n"), record("metadata", "ma", b"k: v", concurrent_to="<urn:ra>"),
        # All name the response, one twice over and one through another.
        record("request", "rb2", b"GET /2", concurrent_to=["<urn:b>", "<urn:mb>"]), record("response", "b", b"HTTP/1.1 200 OK\r\n\r\n", "sha1:00"),
        record("request", "rb1", b"GET /1", concurrent_to="<urn:b>"), record("metadata", "mb", b"1", concurrent_to="<urn:b>"),
        record("metadata", "mc", b"2", concurrent_to="<urn:mb>"), record("metadata", "mc", b"2", concurrent_to="<urn:mb>"),
        record("resource", "c", b"as it is"), record("metadata", "lost", b"", concurrent_to="<urn:nowhere>"),
        record("request", "alone", b"GET /"),
    ]
    content = {"plain": b"".join, "members": lambda p: b"".join(map(gzip.compress, p)), "whole": lambda p: gzip.compress(b"".join(p))}[packed](parts)
    got = {r.record_id: r for r in warc.assemble(parsed(spark, content)).collect()}
    assert set(got) == {"<urn:a>", "<urn:b>", "<urn:c>"}
    a, b, c = (got[f"<urn:{x}>"] for x in "abc")
    assert a.request.record_id == "<urn:ra>" and [m.record_id for m in a.metadata] == ["<urn:ma>"]
    assert a.intact and bytes(a.payload) == b"body\r\n\r\nWARC/1.0\r\n"
    assert b.request.block == "GET /1" and [m.record_id for m in b.metadata] == ["<urn:mb>", "<urn:mc>"]
    assert b.intact is False and b.payload_bytes == 0
    assert c.request is None and c.metadata == [] and c.payload_bytes == 8
    with pytest.raises(ValueError):
        list(warc.parse_archive(content[:-9], True))
