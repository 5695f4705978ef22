"""WARC archives: write pages as segmented, chunk-framed, deduplicated records, and read archives back.

Writing.  Each page is a ``response`` record; of pages with equal payloads of at least ``min_revisit_bytes`` only the
one with the largest id is, the others are ``revisit`` records that refer to it and hold no payload.  A block longer
than ``segment_bytes`` goes on in ``continuation`` records.  Every file begins with a ``warcinfo`` record, and every record is a
gzip member of its own.  Records go through Spark's text sink into the shared folder, so any store that Spark writes will
do: a member ends with the top byte of its length, which is 0 below 16 MB, and that byte is the sink's line separator.
Files are cut by their number of records, each of bounded size, so no file outgrows ``file_bytes`` but for its urls.

Reading.  Each file is parsed record by record by Content-Length (never by searching for a marker, which a payload may
hold).  Records that are whole are decoded where they were read; the segments of others are grouped by origin
identifier, ordered by segment number, joined, checked against the total length, and decoded.  A group is one page's
segments, no more.  A group with a missing or doubled segment or a wrong total has ``intact`` false and no payload.

Null or empty html is an empty payload; a null url is an empty target.  Repeated rows are records of their own (a copy
number in an extension header keeps their segments apart) and of two rows with the largest id both are responses.  A null
id stays null, never is referred to, and revisits the largest id of its payload if there is one.  A very large page is held
by one task, in time linear in its size; very many pages of one payload are dealt over tasks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HotKeys, cut, scratch


def _spans(data: bytes, most: int) -> Iterator[bytes]:
    """Runs of ``data`` of at most ``most`` bytes."""
    return (data[k : k + most] for k in range(0, len(data), most))


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """The payload in chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _spans(payload, chunk_bytes)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + n])
        if len(parts[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + n


def _record(kind: str, record_id: str, block: bytes, *fields: str) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 2024-01-01T00:00:00Z", *fields]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """The record as a gzip member (beyond 8 MB several), without the last byte, which is 0."""
    parts = []
    for span in _spans(record, 1 << 23):
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        parts.append(packer.compress(span) + packer.flush())
    return b"".join(parts)[:-1]


def page_records(page: tuple, copy: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one (id, url, payload, digest, refers to)."""
    page_id, url, payload, digest, refers_to = page
    own = f"<urn:page:{'' if page_id is None else page_id}>"
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Copy: {copy}", "Content-Type: application/http; msgtype=response"]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record("revisit", own, head + b"\r\n", *fields, profile, f"WARC-Refers-To: <urn:page:{refers_to}>")
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record("response", own, block, *fields)
        return
    count = -(-len(block) // segment_bytes)
    for k, s in enumerate(_spans(block, segment_bytes), 1):
        more = [f"WARC-Segment-Number: {k}", *([f"WARC-Segment-Total-Length: {len(block)}"] if k == count else [])]
        if k == 1:
            yield _record("response", own, s, *fields, *more)
        else:
            yield _record("continuation", f"{own[:-1]}:{k}>", s, f"WARC-Segment-Origin-ID: {own}", f"X-Copy: {copy}", *more)


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 1000,
    segment_bytes: int = 16_384, chunk_bytes: int = 4096, file_bytes: int = 64_000_000,
) -> None:
    """Write ``pages`` as WARC files of at most about ``file_bytes`` (before compression) under ``path``."""
    html = F.coalesce(html_col, F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    found = rows.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max("id").alias("of")).where("n > 1")
    found = cut(found, "digests")
    if found.limit(200_001).count() <= 200_000:
        rows = rows.join(F.broadcast(found.drop("n")), ["digest", "bytes"], "left")
    else:
        rows = HotKeys(found.drop("of"), ["digest", "bytes"], pages.count()).join(rows, found.drop("n"), ["id", "url"], "left")
    rows = rows.withColumn("refers", F.when(F.col("of").isNotNull() & ~F.col("id").eqNullSafe(F.col("of")), F.col("of")))
    per_file = max(2, file_bytes // (segment_bytes + 1000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, written = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            out, held = [], 0
            for i in range(b.num_rows):
                page_id, url, text, digest, refers = (c[i].as_py() for c in b.columns)
                k += 1
                for record in page_records((page_id, url, text.encode(), digest, refers), f"{part}-{k}", segment_bytes, chunk_bytes):
                    if written % per_file == 0:  # the sink begins a file here
                        info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
                        out.append(member(_record("warcinfo", f"<urn:info:{part}-{written}>", info, "Content-Type: application/warc-fields")))
                        written += 1
                    out.append(member(record))
                    written += 1
                    held += len(out[-1])
                    if held > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    out = rows.select("id", "url", "html", "digest", "refers").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("compression", "none").option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


def _plain(data: bytes, step: int = 16_384) -> Iterator[bytes]:
    """The contents of a file of gzip members, fed a step at a time: what is left over behind a member is never more than a step."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            if at >= len(view):
                raise ValueError("the last member is cut short")
            fed = view[at : at + step]
            yield unpacker.decompress(fed)
            at += len(fed) - len(unpacker.unused_data)
        while at < len(view) and not view[at]:  # padding
            at += 1


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of one file, plain or of gzip members."""
    if data[:2] == b"\x1f\x8b":
        data = b"".join(_plain(data))
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
        n = int(headers["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n:
            raise ValueError(f"the record at byte {at} is cut short")
        yield headers, block
        at = end + 4 + n + 4


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response, out of its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n"))
    return unchunked(body) if framed else body


_FIELDS = "origin string, copy string, type string, url string, stated string, refers string, number int, total long"
_READ = "origin string, type string, url string, digest string, payload_bytes long, refers string, payload binary, intact boolean"


def _decoded(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    """rows: (origin, type, url, stated digest, refers, block or None)."""
    out = []
    for origin, kind, url, stated, refers, block in rows:
        if kind == "revisit":
            out.append((origin, kind, url, stated, None, refers, None, True))
            continue
        try:
            payload = http_payload(block) if block is not None else None
        except ValueError:
            payload = None
        digest = hashlib.sha1(payload).hexdigest() if payload is not None else None
        whole = payload is not None and stated in (None, digest)
        out.append((origin, kind, url, digest, len(payload) if whole else None, None, payload if whole and payloads else None, whole))
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """origin, type, url, digest, payload_bytes, refers, payload, intact of each page record under ``path``.

    ``payloads`` false leaves the payloads out once they have been measured.  A revisit's digest is the one it states.
    """
    schema = f"{_FIELDS}, block binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for h, block in parse_warc(content.as_py()):
                    kind = h.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    stated = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
                    origin = h.get("warc-segment-origin-id") if kind == "continuation" else h["warc-record-id"]
                    rows.append((origin, h.get("x-copy", ""), kind, h.get("warc-target-uri"), stated, h.get("warc-refers-to"), number and int(number), total and int(total), block))
                    held += len(block)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _decoded([tuple(c[i].as_py() for c in b.columns) for i in range(b.num_rows)], payloads)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    records = files.mapInArrow(parse, schema)
    whole = records.where("number is null").select("origin", "type", "url", "stated", "refers", "block").mapInArrow(decode, _READ)
    parts = records.where("number is not null").groupBy("origin", "copy").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max("url").alias("url"),
        F.max("stated").alias("stated"),
    )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                origin, segments, total, url, stated = (c[i].as_py() for c in b.columns)
                block = b"".join(p["block"] for p in segments)
                good = [p["number"] for p in segments] == list(range(1, len(segments) + 1)) and len(block) == total
                yield _decoded([(origin, "response", url, stated, None, block if good else None)], payloads)

    return whole.union(parts.select("origin", "parts", "total", "url", "stated").mapInArrow(assemble, _READ))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    What is returned comes from the archives alone; a revisit's length is that of the response it refers to.
    A record that is not intact has no length and no digest.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(pages, path, **options)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    rows = read_warc(spark, path, payloads=False).select(
        F.nullif(number("origin"), F.lit("")).cast("long").alias("page_id"), "payload_bytes", F.when(F.col("intact"), F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.nullif(number("refers"), F.lit("")).cast("long").alias("refers_to"),
    )
    rows = cut(rows, "records")
    again = rows.where("record_type = 'revisit'").drop("payload_bytes")
    of = rows.where("record_type = 'response' and page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = again.join(of.withColumnRenamed("page_id", "refers_to"), ["refers_to", "payload_digest"], "left")
    return rows.where("record_type = 'response'").unionByName(again.select(rows.columns))


#: DuckDB: what a round trip over table ``pages`` must return.
ROUND_TRIP_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
m as (select html, max(page_id) as top from p where strlen(html) >= 1000 group by html)
select p.page_id, strlen(p.html)::bigint as payload_bytes, sha1(p.html) as payload_digest,
  case when m.top is not null and p.page_id is distinct from m.top then 'revisit' else 'response' end as record_type,
  case when p.page_id is distinct from m.top then m.top end as refers_to
from p left join m on p.html = m.html
"""
