"""WARC archives without repeated payloads.

Headers only (id, digest, size) are shuffled: by payload digest to find the original of each payload, then back to the
pages. Revisit records refer to their original and carry no payload; every record gets fresh headers. The archives are
read back by the content lengths in their headers.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, scratch, table, written
from .registry import query

#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 100
#: Records of an archive file, which is read back by one task.
RECORDS = 2_000
#: Revisits up to which their ids are broadcast, so payloads stay where they are; beyond, both sides are shuffled.
SHIPPED = 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def originals(pages: DataFrame, least_bytes: int = LEAST_BYTES, salts: int = 64) -> DataFrame:
    """(page_id, payload_key, original): for every page that is not its own original, the smallest page_id of its payload.

    ``payload_key`` is the payload's digest, since a page_id may come with several payloads.

    A hot digest is counted and joined in ``salts`` parts, so no task holds all of its pages.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    headers = pages.select("page_id", F.octet_length(payload).alias("size"), F.sha2(payload, 256).alias("digest"))
    headers = headers.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull())
    headers = headers.select("page_id", F.unhex("digest").alias("digest"), F.pmod(F.xxhash64("page_id"), F.lit(salts)).alias("salt"))
    headers = written(headers, "payload-headers")
    parts = written(headers.groupBy("digest", "salt").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")), "payload-parts")
    whole = parts.groupBy("digest").agg(F.min("least").alias("original"), F.sum("n").alias("n")).where("n > 1")
    known = written(parts.select("digest", "salt").join(whole.select("digest", "original"), "digest"), "payload-originals")
    found = headers.join(known, ["digest", "salt"]).where("page_id <> original").select("page_id", F.col("digest").alias("payload_key"), "original")
    found = written(found.distinct(), "revisits")
    for done in (headers, parts, known):
        remove(done)
    return found


def _record(payload: Column, size: Column, digest: Column) -> Column:
    """Headers and block of one record; a revisit has an empty block and names its original."""
    revisit = F.col("original").isNotNull()
    uri = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]+", " ")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.concat(F.lit("X-Payload-Length: "), size.cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("original").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(size.cast("string"))),
    ]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), F.when(revisit, "").otherwise(payload))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write gzipped archives of all pages (page_id, url, html) to ``path``, a folder all executors reach.

    A null html is an empty payload. A page row repeated with the same id is written as often as it occurs, of the same
    type; so is the original. Rows with a null page_id are written as responses.
    """
    found = originals(pages, least_bytes)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    raw = F.encode(payload, "UTF-8")
    joined = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.octet_length(raw).alias("size"), F.sha2(raw, 256).alias("digest")
    ).withColumn("payload_key", F.unhex("digest")).join(F.broadcast(found) if found.count() <= SHIPPED else found, ["page_id", "payload_key"], "left")
    lines = joined.select(_record(F.col("payload"), F.col("size"), F.col("digest")).alias("value"))
    # The writer ends each line with an empty line, as records of an archive end.
    lines.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


_HEADER = re.compile(rb"(?m)^([\w-]+): ?(.*?)\r$")
FIELDS = "page_id long, url string, record_type string, refers_to long, declared_bytes long, declared_digest string, payload binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            data = memoryview(gzip.decompress(content.as_py()))
            at, rows, held = 0, [], 0
            while at < len(data):
                head = bytes(data[at : at + 65536])
                stop = head.find(b"\r\n\r\n")
                if stop < 0 and len(data) - at > 65536:  # a very long URL
                    head = bytes(data[at:])
                    stop = head.find(b"\r\n\r\n")
                if not head.startswith(b"WARC/1.") or stop < 0:
                    raise ValueError("an archive holds something that is no record")
                fields = {k.lower(): v.decode() for k, v in _HEADER.findall(head[: stop + 2])}
                size = int(fields[b"content-length"])
                begin = at + stop + 4
                at = begin + size + 4
                page, refers = (re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(k, "")) for k in (b"warc-record-id", b"warc-refers-to"))
                rows.append(
                    (
                        int(page[1]) if page else None, fields.get(b"warc-target-uri"), fields[b"warc-type"], int(refers[1]) if refers else None,
                        int(fields[b"x-payload-length"]), fields[b"warc-payload-digest"].partition(":")[2], bytes(data[begin : begin + size]),
                    )
                )
                held += size
                if held > 8 << 20:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse, FIELDS)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and digest of a response from its payload; those of a revisit from its headers."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("record_type", "payload", "declared_bytes", "declared_digest")), strict=True)
        found = [(len(p), hashlib.sha256(p).hexdigest()) if t == "response" else (n, d) for t, p, n, d in rows]
        yield pa.record_batch(
            {
                "page_id": batch.column("page_id"), "payload_bytes": pa.array([f[0] for f in found], pa.int64()), "payload_digest": pa.array([f[1] for f in found], pa.string()),
                "record_type": batch.column("record_type"), "refers_to": batch.column("refers_to"),
            }
        )


OP7_SQL = f"""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), o AS (SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= {LEAST_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
"""


@query("op7_warc_revisits", OP7_SQL)
def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records of deduplicated archives, read back from the files."""
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    kept = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return read_archives(spark, path).mapInArrow(_digested, kept)
