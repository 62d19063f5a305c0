"""Operator 6: WARC archives in which equal payloads are stored once.

Payloads are packed where they lie, into staged records in the shared folder;
only headers (digest, page_id, url, place) are shuffled, by payload digest.  Of
the records with one payload the largest id is the response and the others
become revisits.  The headers then go back to their staged files: packed
responses are copied as they are, revisits are written anew with fresh headers,
one gzip member each.  Reading joins the revisits to their responses again by
digest.  A digest that most records share is one row of the duplicates' table;
the headers stream past it and are split by the skew handling of adaptive
execution, never gathered.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, scratch
from .tokenfile import open_fs

#: Payloads of at least so many bytes are stored once.
MIN_BYTES = 0
#: Fixed by the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


#: What stands for itself in an escaped url must be escaped too, so that no two urls give one header.
_ESCAPED = re.compile("%(?=0[AaDd]|25)")


def _uri(url: str | None, page_id) -> str:
    """A header can't hold line ends: those of a url are escaped; no url gives a urn of the id."""
    if url is None:
        return f"urn:x-page:{page_id}"
    return _ESCAPED.sub("%25", url).replace("\r", "%0D").replace("\n", "%0A")


def _page_record(page, url, digest: str, date: str, payload: bytes | None, size: int, response=None) -> bytes:
    """A response with its payload, or without one a revisit of the page `response`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    headers = [
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url, page)),
        ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page is not None:
        headers.append(("X-Page-Id", str(page)))
    if payload is None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(response, digest))]
    return _record("response" if payload is not None else "revisit", headers, block)


STAGED = "staged string, at long, size long, page_id long, url string, digest string, payload_bytes long"


def _stage(folder: str, date: str):
    """Pack every payload as a response, in a file of this attempt's own; returns the headers."""

    def run(batches):
        fs, path = open_fs(f"{folder}/staged")
        name, at = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", 0
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                rows: list = []
                for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    payload = (html or "").encode()
                    digest = hashlib.sha1(payload).hexdigest()
                    packed = _page_record(page, url, digest, date, payload, len(payload))
                    out.write(packed)
                    rows.append((name, at, len(packed), page, url, digest, len(payload)))
                    at += len(packed)
                if rows:
                    kinds = [pa.string() if c in ("staged", "url", "digest") else pa.int64() for c in _names(STAGED)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_names(STAGED))

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _write(folder: str, date: str):
    """An archive for each staged file, whose headers come sorted by their place."""

    def run(batches):
        fs, path = open_fs(folder)
        name = own = out = stage = staged = None
        n = 0

        def done():
            out.close()
            stage.close()
            fs.move(own, f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"file": pa.array([name]), "n_records": pa.array([n], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if row["staged"] != staged:
                    if out is not None:
                        yield done()
                    staged, n = row["staged"], 0
                    name = f"part-{staged}.warc.gz"
                    own = f"{path}/{name}.{uuid.uuid4().hex}"
                    out, stage = fs.open_output_stream(own, compression=None), fs.open_input_file(f"{path}/staged/{staged}")
                    info = f"software: runsieve\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
                    fresh = [("WARC-Date", date), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>")]
                    out.write(_record("warcinfo", [*fresh, ("Content-Type", "application/warc-fields")], info))
                page, response = row["page_id"], row["response_id"]
                if response is not None and response != page:
                    out.write(_page_record(page, row["url"], row["digest"], date, None, row["payload_bytes"], response))
                else:
                    out.write(stage.read_at(row["size"], row["at"]))
                n += 1
        if out is not None:
            yield done()

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, date: str | None = None) -> DataFrame:
    """Write a record for each row (page_id, url, html); returns the table of files.

    The payload is the whole html in UTF-8 (null: empty).  Of records with equal
    payloads of at least min_bytes bytes, that with the largest page_id is the
    response and the others are revisits of it; a row without page_id revisits
    if any equal one has an id.  Rows that repeat both page_id and payload have
    the same place: if it is the largest, each of them is a response.  Other
    columns of pages don't matter; an empty table gives no files.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    heads = materialise(rows.mapInArrow(_stage(folder, date), STAGED), "warc_heads")
    large = F.col("payload_bytes") >= min_bytes
    shared = heads.filter(large).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
    shared = materialise(shared.filter("n > 1").drop("n"), "warc_shared")
    heads = heads.join(shared.hint("shuffle_hash"), "digest", "left")
    n_files = max(1, heads.select("staged").distinct().count())
    heads = heads.repartition(n_files, "staged").sortWithinPartitions("staged", "at")
    heads.mapInArrow(_write(folder, date), "file string, n_records long").write.parquet(f"{folder}/files")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/staged")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.read.parquet(f"{folder}/files")


def parse_records(stream):
    """(headers, block) of each record of an open .warc.gz stream, one record in memory at a time."""
    z, data, held = zlib.decompressobj(31), b"", []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        held.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            text = b"".join(held)
            if text:
                head, _, rest = text.partition(b"\r\n\r\n")
                lines = head.decode("utf-8", "replace").split("\r\n")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                yield headers, rest[: int(headers["content-length"])]
            z, held = zlib.decompressobj(31), []
        elif data:
            raise ValueError("a gzip member does not end")
    if any(held):
        raise ValueError("the last record is cut off")


HEADERS = "record_id string, record_type string, page_id long, uri string, digest string, payload_bytes long, refers_to_record string"


def _read(folder: str):
    def run(batches):
        fs, path = open_fs(folder)
        names = [x.split()[0] for x in HEADERS.split(", ")]
        kinds = pa.schema([(c, pa.int64() if c in ("page_id", "payload_bytes") else pa.string()) for c in names])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for h, block in parse_records(stream):
                        kind = h.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        digest, size = h.get("warc-payload-digest", "").removeprefix("sha1:"), None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size = len(payload)
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"{name}: the payload of {h.get('warc-record-id')} is not that of its digest")
                        page = h.get("x-page-id")
                        rows.append((h.get("warc-record-id"), kind, page and int(page), h.get("warc-target-uri"), digest, size, h.get("warc-refers-to")))
                        if len(rows) >= 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    return run


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The headers of all records of the files; a response's payload is held against its digest."""
    files = spark.read.parquet(f"{folder}/files").select("file")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "file").mapInArrow(_read(folder), HEADERS)


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """Headers with payload_bytes and refers_to (a page_id) of revisits from the response with their digest.

    Of several responses with one digest the largest page_id counts; a revisit
    without a response keeps nulls.
    """
    original = headers.filter("record_type = 'response'").groupBy("digest")
    original = original.agg(F.max(F.struct("page_id", "payload_bytes")).alias("o"))
    wanted = headers.filter("record_type = 'revisit'").select("digest").distinct()
    original = materialise(original.join(wanted, "digest", "left_semi"), "warc_originals")
    out = headers.join(original.hint("shuffle_hash"), "digest", "left")
    again = F.col("record_type") == "revisit"
    return out.select(
        "record_id",
        "record_type",
        "page_id",
        "uri",
        F.col("digest").alias("payload_digest"),
        F.when(again, F.col("o.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("o.page_id")).alias("refers_to"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), folder)
    headers = materialise(read_headers(spark, folder), "warc_headers")
    return resolve_revisits(headers).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in base32: five hex digits are four letters of the alphabet that RFC 4648 fixes.
ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS response_id FROM p)
SELECT page_id, octet_length(payload) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, 1 + CAST(i // 4 AS INT) * 5, 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response_id THEN response_id END AS refers_to
FROM g
"""
