"""WARC archives: a writer with revisit records and a splittable reader.

Writing: one gzip member per record. Spark's own text writer puts the members
into files, so its commit protocol covers lost executors; the separator it
writes after each row is an empty gzip member, which every gzip reader skips.

Reading: files are cut into byte ranges. A task looks for the gzip magic in its
range, tries each candidate by inflating and parsing the record's header, and
owns the records that start inside; the last one may end beyond the range.
"""

from __future__ import annotations

import base64
import gzip
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import drop, scratch, written

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
READ = 1 << 20
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, digest_ok boolean, path string, offset long"


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def member(page_id, url, payload: bytes, sha1_hex: str, refers_to, level: int = 4) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP header alone."""
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    clean = " ".join((url or "").split())
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _members(batches):
    import pyarrow as pa

    for b in batches:
        cols = [b.column(i) for i in range(b.num_columns)]
        out = []
        for page_id, url, html, sha, ref in zip(*(c.to_pylist() for c in cols), strict=True):
            out.append(member(page_id, url, html or b"", sha, ref))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def with_revisits(pages: DataFrame, spark: SparkSession, least: int = 0) -> DataFrame:
    """page_id, url, payload, sha, refers_to: of equal payloads of ``least`` bytes or more the largest page_id is kept.

    Every row gives one: repeated rows of that page_id all stay whole, as do groups whose page_ids are
    all null; a null page_id in another group refers to the largest. Null payloads are empty. Columns
    other than page_id, url and html are not kept.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    kept = (
        base.where(F.octet_length("payload") >= least)
        .groupBy("sha")
        .agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
        .where("n > 1 and keep is not null")
        .select("sha", "keep")
    )
    kept = written(spark, kept, "warc-kept")  # its size is then known before the join is planned
    return base.join(kept, "sha", "left").select(
        "page_id",
        "url",
        "payload",
        "sha",
        F.when(F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str, spark: SparkSession, least: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``."""
    members = with_revisits(pages, spark, least).mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", EMPTY_MEMBER.decode("latin-1")
    ).text(path)


def opened(path: str):
    """A seekable binary file at a path or URI."""
    if path.startswith("/"):
        return open(path, "rb")
    if path.startswith("file:"):
        from urllib.parse import unquote, urlparse

        return open(unquote(urlparse(path).path), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _inflate(f, at: int, start: bytes):
    """(content, bytes used) of the gzip member at ``at``, or None: not a member, or no WARC record."""
    z = zlib.decompressobj(31)
    out, used, data, head = [], 0, start, b""
    try:
        while True:
            out.append(z.decompress(data))
            used += len(data) - len(z.unused_data)
            if len(head) < 7:
                head += out[-1][:7]
                if head and not b"WARC/1.".startswith(head[:7]):
                    return None
            if z.eof:
                return (b"".join(out), used) if head.startswith(b"WARC/1.") else None
            f.seek(at + used)
            data = f.read(READ)
            if not data:
                return None
    except zlib.error:
        return None


def parse(content: bytes) -> tuple[dict, bytes]:
    """The header fields (names in lower case) and the block of one record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    return fields, rest[: int(fields["content-length"])]


def scan_range(path: str, lo: int, hi: int):
    """(offset, fields, block) of the records that start in [lo, hi)."""
    with opened(path) as f:
        at, data, base = lo, b"", lo
        while at < hi:
            p = data.find(MAGIC, at - base)
            if p < 0:
                nxt = base + max(len(data) - 2, 0)
                at = max(at, nxt) if data else at
                if at >= hi:
                    return
                f.seek(at)
                base, data = at, f.read(READ)
                if len(data) < 3:
                    return
                if data.find(MAGIC) < 0 and len(data) < READ:
                    return
                continue
            at = base + p
            if at >= hi:
                return
            found = _inflate(f, at, data[p:])
            if found is None:
                at += 1
                continue
            try:
                fields, block = parse(found[0])
            except (KeyError, ValueError):
                at += 1
                continue
            yield at, fields, block
            at += found[1]
            if at - base > len(data):
                f.seek(at)
                base, data = at, f.read(READ)


def _ranges(batches):
    import hashlib

    import pyarrow as pa

    names = [x.split()[0] for x in RECORD.split(", ")]
    for b in batches:
        for path, lo, hi in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            rows, held = [], 0
            for offset, fields, block in scan_range(path, lo, hi):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                kind = fields["warc-type"]
                digest = fields["warc-payload-digest"].split(":", 1)[1]
                ok = base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest if kind == "response" else None
                page, ref = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                rows.append((
                    int(page) if page is not None else None, fields.get("warc-target-uri") or None, kind, size, digest,
                    int(ref) if ref is not None else None, payload if kind == "response" else None, ok, path, offset,
                ))
                held += len(payload)
                if held > 8 << 20:
                    yield _batch(rows, names, pa)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, names, pa)


def _batch(rows, names, pa):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str, range_bytes: int = 4 << 20) -> DataFrame:
    """All records of the WARC files under ``path``, read by byte ranges.

    A null url comes back null, an empty payload as zero bytes; revisit records have no
    payload of their own, ``payload_bytes`` and the digest are those of the page.
    No files give no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    ranges = files.where("length > 0").select(
        "path", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes))).alias("lo"), "length"
    ).select("path", "lo", F.least(F.col("lo") + range_bytes, "length").alias("hi"))
    n = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(n).mapInArrow(_ranges, RECORD)


def op9_warc(spark, sf_dir):
    """``pages`` written as WARC archives in the shared folder and read back by byte ranges."""
    path = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, spark)
    back = read_archives(spark, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
m AS (SELECT sha, max(page_id) AS keep FROM p GROUP BY sha),
g AS (SELECT p.*, m.keep, list_transform(range(0, 8), lambda i: ('0x' || substr(p.sha, i::int * 5 + 1, 5))::int) AS v FROM p JOIN m USING (sha))
SELECT page_id, strlen(html)::bigint AS payload_bytes,
  list_aggregate(list_transform(v, lambda x: substr(a, (x >> 15) + 1, 1) || substr(a, ((x >> 10) & 31) + 1, 1)
    || substr(a, ((x >> 5) & 31) + 1, 1) || substr(a, (x & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to,
  CASE WHEN page_id = keep THEN true END AS digest_ok
FROM g, (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a)
"""
