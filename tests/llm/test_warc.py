"""WARC archives: exact round trips and revisit resolution."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from pathlib import Path

import pytest
from conftest import SMALL, duck_rows, rows
from pyspark.sql import functions as F

from visitcast.llm import warc
from visitcast.llm.common import scratch_path

LONG = "<p>é\r\n\r\nWARC/1.1\r\n\r\n" + "x" * 120
PAGES = [
    (5, "http://a/5 x", LONG), (3, None, LONG), (9, "http://a/9", LONG), (1, "http://a/1", "short"), (2, "http://a/2", "short"), (4, "u", None), (6, "u", ""), (None, "http://n", LONG),
    (7, "u", "y" * 100), (8, "u", "y" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "é" * 50), (13, "v", "é" * 50), (3, None, LONG), (14, "u", "\x00\x01 \U0001f600" * 5000),
]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    typed = warc.typed(df, rows=0 if compression == "none" else 1000)
    warc.write(typed, f"{tmp_path}/w", archive=20_000, compression=compression)
    got = warc.resolve(warc.read(spark, f"{tmp_path}/w")).collect()
    assert len(got) == len(PAGES)
    first = {LONG: 3, "y" * 100: 7, "é" * 50: 12}
    want = []
    for i, _, h in PAGES:
        data, f = (h or "").encode(), first.get(h)
        again = f is not None and (i is None or i > f)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f if again else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.header_digest == r.payload_digest for r in got)
    files = list(Path(f"{tmp_path}/w").glob("part-*"))
    seen = [x for p in files for x in warc.parse(p.read_bytes()) if x[0]["warc-type"] != "warcinfo"]
    assert len({f["warc-record-id"] for f, _ in seen}) == len(PAGES) and len(files) > 3
    assert all(p.name.endswith(".warc.gz" if compression == "gzip" else ".warc") for p in files)
    assert all(next(warc.parse(p.read_bytes()))[0]["warc-type"] == "warcinfo" for p in files)
    if compression == "gzip":
        assert all(_members(p.read_bytes()) for p in files)
    assert len(seen) == len(PAGES) and sum(b.partition(b"\r\n\r\n")[2] == LONG.encode() for _, b in seen) == 2
    assert all(len(b) == int(f["content-length"]) for f, b in seen)
    assert {f.get("warc-target-uri") for f, _ in seen} >= {"http://a/5%20x", None}


def _members(data: bytes) -> list[bytes]:
    """The content of each gzip member: one record, or nothing between two."""
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        assert z.eof and len(list(warc.parse(out[-1]))) <= 1
        data = z.unused_data
    return out


def test_responses_are_not_joined(spark):
    """A hot payload's revisits and many responses: all come back, once each, also where nothing may be broadcast."""
    pages = spark.range(300).selectExpr("id AS page_id", "'u' AS url", f"IF(id % 3 = 0, '{'h' * 200}', repeat(string(id), 100)) AS html", "'x' AS digest", "1 AS size", "'p' AS payload", "'r' AS record_type", "2 AS row")
    for limit in (0, 1000):
        path = scratch_path(spark, "warc")
        warc.write(warc.typed(pages, rows=limit), path)
        got = warc.resolve(warc.read(spark, path), rows=limit).collect()
        assert len(got) == 300 and sum(r.record_type == "revisit" for r in got) == 99 == sum(r.refers_to == 0 for r in got)
        assert all(r.payload_bytes and r.payload_digest for r in got)


def test_archives_are_cut_by_bytes(spark, tmp_path):
    """Large records first, then many small ones: no file passes the bound by more than a record; one larger than it is alone."""
    size, bound = 200_000, 600_000
    pages = [(i, "u", f"{i}" + "x" * size) for i in range(60)] + [(i, "u", f"small {i}") for i in range(60, 3000)] + [(3000, "u", "L" * 2 * bound)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "row", "first_id", "size", "payload", "value")}).coalesce(1)
    warc.write(warc.typed(df).coalesce(1), f"{tmp_path}/w", archive=bound)
    sizes = []
    for p in Path(f"{tmp_path}/w").glob("*.warc.gz"):
        found = list(warc.parse(p.read_bytes()))
        assert found[0][0]["warc-type"] == "warcinfo" and [f["warc-type"] for f, _ in found].count("warcinfo") == 1
        sizes.append((len(gzip.decompress(p.read_bytes())), len(found) - 1))
    # Four bytes end each record.
    assert all(s <= bound + 500 + 4 * n or n == 1 for s, n in sizes) and len(sizes) >= 30
    assert sum(n for _, n in sizes) == len(pages) and [n for s, n in sizes if s > 2 * bound] == [1]
    assert warc.resolve(warc.read(spark, f"{tmp_path}/w")).count() == len(pages)


def test_broken_archives():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert len(list(warc.parse(good * 2))) == 2 and list(warc.parse(b"")) == []
    for bad in (good[:-1], good[:-5], b"junk\r\n\r\n", b"junk"):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_equal_to_sql(spark, duck):
    assert rows(warc.op10_warc_revisits(spark, SMALL)) == duck_rows(duck, warc.ORACLE_SQL)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string, record_type string")
    warc.write(warc.typed(df), f"{tmp_path}/e")
    assert warc.resolve(warc.read(spark, f"{tmp_path}/e")).count() == 0
