"""WARC archives with revisit resolution.

``resolve`` decides, per record, whether its payload is stored or refers to another record: headers (id, digest,
size; never payloads) are aggregated by payload digest, and of equal payloads of at least ``MIN_PAYLOAD`` bytes the
record with the smallest id keeps its payload while the others become revisit records of it.  Smaller payloads are
always stored.  ``write_warc`` writes gzip-per-record WARC/1.1 files with fresh headers, one or more a task, and
``read_warc`` reads them back; ``with_originals`` joins revisits with the responses they refer to.

Rows: a null payload is an empty payload.  Records that repeat (same id, same payload) are all responses, because
none has a smaller id than another.  Records with a null id are always stored and never referred to.  Null urls
are written as ``about:blank``.  An empty table gives no file and no row.  Other columns are ignored.  File names
carry the task attempt; only files in the committed manifest count.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import keep, scratch
from plumbline.llm.token_files import file_system

MIN_PAYLOAD = 100
FILE_BYTES = 1 << 28
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, digest: str) -> str:
    """The same record gets the same identifier in every run."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}:{digest}')}>"


def resolve(records: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    full = records.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    full = full.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha2("payload", 256))
    headers = full.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_payload)).select(
        "page_id", "payload_digest")
    originals = (headers.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
                 .where("n > 1").drop("n"))
    # only records that may refer to another one meet here; a digest that very many share is a skewed join, not a group
    revisits = (headers.join(originals, "payload_digest").where("page_id > original")
                .select("page_id", "payload_digest", F.col("original").alias("refers_to")).distinct())
    joined = full.join(revisits, ["page_id", "payload_digest"], "left")
    stored = F.col("refers_to").isNull()
    return joined.select(
        "page_id", "url", F.when(stored, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(stored, "response").otherwise("revisit").alias("record_type"), "refers_to")


def _block(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def _clean(url: str | None) -> str:
    return "".join(ch for ch in url or "about:blank" if ch not in "\r\n")


def warc_record(row: dict) -> bytes:
    """One record with its headers; the http block of a revisit has no payload."""
    digest = row["payload_digest"]
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {row['payload_bytes']}\r\n\r\n").encode()
    body = http + (row["payload"] if row["record_type"] == "response" else b"")
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["page_id"], digest)),
               ("WARC-Target-URI", _clean(row["url"])), ("WARC-Date", EPOCH),
               ("WARC-Payload-Digest", f"sha256:{digest}"),
               ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode())]
    if row["page_id"] is not None:
        headers.append(("X-Page-ID", str(row["page_id"])))
    if row["record_type"] == "revisit":
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(row["refers_to"], digest)),
                    ("X-Refers-To-Page-ID", str(row["refers_to"]))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return _block(headers, body)


def _info() -> bytes:
    body = b"software: plumbline\r\nformat: WARC File Format 1.1\r\n"
    return _block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, 'info')}>"),
                   ("WARC-Date", EPOCH), ("Content-Type", "application/warc-fields"),
                   ("Content-Length", str(len(body)))], body)


def _write(folder: str, file_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = file_system(folder)
        paths, counts, stream, size = [], [], None, 0
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist()):
                if stream is None or size > file_bytes:
                    if stream is not None:
                        stream.close()
                    system.create_dir(base, recursive=True)
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(paths):04d}.warc.gz"
                    stream = system.open_output_stream(f"{base}/{name}", compression=None)
                    size = stream.write(gzip.compress(_info(), 6, mtime=0)) or 0
                    paths.append(f"{folder}/{name}")
                    counts.append(0)
                data = gzip.compress(warc_record(row), 6, mtime=0)
                stream.write(data)
                size += len(data)
                counts[-1] += 1
        if stream is not None:
            stream.close()
            yield pa.record_batch({"path": pa.array(paths), "n_records": pa.array(counts, pa.int64())})
    return run


def write_warc(resolved: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives below ``folder``; the manifest: path, n_records."""
    return keep(resolved.mapInArrow(_write(folder, file_bytes), "path string, n_records long"), "warc-manifest")


def gzip_members(source) -> Iterator[bytes]:
    """Plain bytes of each gzip member of a file, read in pieces."""
    engine, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or source.read(1 << 20)
        if not data:
            if out:
                raise ValueError("archive ends inside a record")
            return
        out.append(engine.decompress(data))
        rest = b""
        if engine.eof:
            yield b"".join(out)
            rest, engine, out = engine.unused_data, zlib.decompressobj(31), []


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(lower-cased headers, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[:int(headers["content-length"])]


READ = ("record_id string, record_type string, page_id long, url string, payload_digest string, refers_to_record string, "
        "refers_to long, payload binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, path = file_system(row["path"])
            with system.open_input_file(path) as source:
                out, size = [], 0
                for data in gzip_members(source):
                    headers, block = parse_record(data)
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    stored = headers["warc-type"] == "response"
                    page, other = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                    out.append((headers["warc-record-id"], headers["warc-type"], int(page) if page else None,
                                headers["warc-target-uri"], headers["warc-payload-digest"].removeprefix("sha256:"),
                                headers.get("warc-refers-to"), int(other) if other else None,
                                block.partition(b"\r\n\r\n")[2] if stored else None))
                    size += len(block)
                    if size > 1 << 22:
                        yield _rows(out)
                        out, size = [], 0
                if out:
                    yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_warc(manifest: DataFrame) -> DataFrame:
    """Response and revisit records of the archives in ``manifest`` (column path)."""
    tasks = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("path").repartition(tasks * 4).mapInArrow(_read, READ)


def with_originals(records: DataFrame) -> DataFrame:
    """Every record with payload_bytes and payload_digest of its full payload, a revisit's taken from its response."""
    measured = records.select(
        "record_id", "record_type", "page_id", "url", "refers_to_record", "refers_to",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    measured = keep(measured, "records")
    responses = measured.where("record_type = 'response'")
    # records that repeat share an identifier
    originals = responses.select(F.col("record_id").alias("refers_to_record"), F.col("payload_bytes").alias("b"),
                                 F.col("payload_digest").alias("d")).distinct()
    revisits = (measured.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
                .join(originals, "refers_to_record", "left")
                .withColumnsRenamed({"b": "payload_bytes", "d": "payload_digest"}))
    return responses.unionByName(revisits)


def revisit_table(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """op7: page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives written."""
    manifest = write_warc(resolve(pages), scratch(spark, "warc"))
    return with_originals(read_warc(manifest)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
