"""WARC archives with revisit resolution.

The payloads are hashed once, into a narrow table of headers and a table of rows.
Headers are shuffled by digest; of records with equal payloads of at least LEAST
bytes the one with the smallest id stays a response, the others become revisits
that refer to it. Archives hold one gzip member a record, each with fresh headers
(a date of the run, an id of its own), after a `warcinfo` record; Spark's own
writer puts them into the shared folder, in files `*.warc.gz` of at most ARCHIVE bytes
before compression (or of one larger record), which bounds what a task holds. Reading
parses records one by one by their Content-Length; only revisits are joined to the
responses that they refer to.

Payloads don't go through a shuffle as long as a count proves that the digests that
occur more than once can be broadcast; beyond, they move once, in a join that
adaptive execution can split.

Defined results: a null payload is an empty one; records below LEAST bytes are all
responses; a null id comes last, so such a record revisits another if there is one;
rows that repeat an id and its payload are each a response, with ids of their own; a
null URL leaves its header out; blanks in a URL are written %20; an empty table gives
no rows; extra columns are ignored, whatever their names (digest, row, size or first_id, too).
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitcast.llm.common import BROADCAST_ROWS, modest, modest_batches, scratch_path, small, table, written

LEAST = 100
ARCHIVE = 16 << 20
NL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, page_id long, url string, record_type string, refers_to_id string, header_digest string, payload_bytes long, payload_digest string"
#: An empty gzip member. Spark's text writer ends each row with something: this leaves the archive's content as it is.
NOTHING = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"


def _record_id(page_id: Column, digest: Column, row: Column) -> Column:
    key = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("-")), digest, row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def typed(pages: DataFrame, least: int = LEAST, rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, payload, size, digest, row (a number of its own), and first_id, first_url and first_row where the record is a revisit."""
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    full = written(full.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256), "row": F.monotonically_increasing_id()}), "warc-rows")
    heads = full.filter(F.col("size") >= least).select("page_id", "url", "digest", "row")
    firsts = heads.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row", "url"))).alias("first"), F.count("*").alias("n"))
    firsts = written(firsts.filter("n > 1 AND first IS NOT NULL").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.row").alias("first_row")), "warc-firsts")
    revisit = (F.col("size") >= least) & F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    return full.join(small(firsts, rows), "digest", "left").select("page_id", "url", "payload", "size", "digest", "row", *[F.when(revisit, F.col(c)).alias(c) for c in ("first_id", "first_url", "first_row")])


def _uri(url: Column) -> Column:
    return F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")


def record(df: DataFrame, date: str) -> Column:
    """The text of a WARC/1.1 record less the blank lines after its block."""
    revisit = F.col("first_id").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), F.col("size").cast("string"), F.lit(NL * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(NL))  # noqa: E731  null if the value is
    head = F.concat_ws(
        "",
        F.lit(f"WARC/1.1{NL}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"), F.col("row"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{NL}"), line("WARC-Refers-To", _record_id(F.col("first_id"), F.col("digest"), F.col("first_row"))))),
        F.when(revisit, line("WARC-Refers-To-Target-URI", _uri(F.col("first_url")))),
        F.when(revisit, line("WARC-Refers-To-Date", F.lit(date))),
        line("X-Page-ID", F.col("page_id").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{NL}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(NL),
    )
    return F.concat(head, block)


def _info(date: str) -> bytes:
    block = f"format: WARC File Format 1.1{NL}".encode()
    key = hashlib.md5(date.encode()).hexdigest()
    name = f"<urn:uuid:{key[:8]}-{key[8:12]}-{key[12:16]}-{key[16:20]}-{key[20:]}>"
    return f"WARC/1.1{NL}WARC-Type: warcinfo{NL}WARC-Record-ID: {name}{NL}WARC-Date: {date}{NL}Content-Type: application/warc-fields{NL}Content-Length: {len(block)}{NL * 2}".encode() + block


def _archives(batches: Iterator[pa.RecordBatch], date: str, archive: int, packed: bool) -> Iterator[pa.RecordBatch]:
    """The bytes of one archive a row: a `warcinfo` record, then records until the next would pass `archive` bytes; a gzip member each."""
    pack = (lambda x: gzip.compress(x + b"\r\n\r\n", 6, mtime=0)) if packed else (lambda x: x)
    join = (b"" if packed else b"\r\n\r\n").join
    done = lambda parts: pa.RecordBatch.from_arrays([pa.array([join(parts)], pa.binary())], ["archive"])
    parts, size = [], 0
    for batch in batches:
        for x in batch.column("value"):
            data = x.as_buffer().to_pybytes()
            if parts and size + len(data) > archive:
                yield done(parts)
                parts, size = [], 0
            parts += [pack(data)] if parts else [pack(_info(date)), pack(data)]
            size += len(data)
    if parts:
        yield done(parts)


def _renamed(spark: SparkSession, path: str, ending: str) -> None:
    """Gives the files of Spark's text writer the ending of archives: one rename a file, however many records it has."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for x in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, "part-*.txt")):
        old = x.getPath()
        files.rename(old, spark._jvm.org.apache.hadoop.fs.Path(at, old.getName().removesuffix(".txt") + ending))


def write(records: DataFrame, path: str, archive: int = ARCHIVE, compression: str = "gzip") -> None:
    """Writes typed() records as archives of at most `archive` bytes before compression (or of one larger record) below `path`.

    A task gathers the bytes of one archive at a time, and Spark's text writer puts each row into a file of its own.
    """
    spark, date, packed = records.sparkSession, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), compression != "none"
    rows = records.select(record(records, date).alias("value")).mapInArrow(lambda it: _archives(it, date, archive, packed), "archive binary")
    # The bytes pass as they are: the writer takes strings for bytes, and the separator, once at the end of a file, in this encoding.
    end = NOTHING.decode("latin-1") if packed else NL * 2
    with modest(spark):
        rows.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", end).option("encoding", "ISO-8859-1").option("compression", "none").text(path)
    _renamed(spark, path, ".warc.gz" if packed else ".warc")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, unpacked one record at a time."""
    file = io.BytesIO(data)
    file = io.BufferedReader(gzip.GzipFile(fileobj=file)) if data[:2] == b"\x1f\x8b" else file
    n = 0
    while first := file.readline():
        n += 1
        if not first.startswith(b"WARC/"):
            raise ValueError(f"record {n} doesn't begin as one")
        fields = {}
        while (line := file.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError(f"the headers of record {n} are cut off")
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = file.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]) or file.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {n} is cut off")
        yield fields, block


def _row(fields: dict[str, str], block: bytes) -> tuple:
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block
    page = fields.get("x-page-id")
    own = (len(payload), hashlib.sha256(payload).hexdigest()) if fields["warc-type"] != "revisit" else (None, None)
    return (fields["warc-record-id"], int(page) if page else None, fields.get("warc-target-uri"), fields["warc-type"], fields.get("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, *own)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64() if " long" in x else pa.string() for x in SCHEMA.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            rows = [_row(*x) for x in parse(content.as_py()) if x[0]["warc-type"] != "warcinfo"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below `path`; payload size and digest are computed anew, null for revisits."""
    modest_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read, SCHEMA)


def resolve(records: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """records with refers_to, and revisits with the size and digest of the response they refer to.

    Responses pass without a join. Those that revisits name are few or one a revisit; the
    revisits of a hot response meet it in a broadcast, or in a join that can be split.
    """
    records = written(records, "warc-records")
    responses, revisits = records.filter("record_type != 'revisit'"), records.filter("record_type = 'revisit'")
    named = written(revisits.select("refers_to_id").distinct(), "warc-named")
    original = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    original = written(original.join(small(named, rows), "refers_to_id", "left_semi"), "warc-originals")
    joined = revisits.drop("payload_bytes", "payload_digest").join(small(original, rows), "refers_to_id", "left").withColumnsRenamed({"_bytes": "payload_bytes", "_digest": "payload_digest"})
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(joined)


def op10_warc_revisits(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(typed(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    return resolve(read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST} AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id > first_id THEN first_id END AS refers_to
FROM f"""
