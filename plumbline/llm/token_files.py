"""Token-id files: independent zstandard frames, per-frame checksums and a trailing seek table.

One shard file per range of documents:

* data frames, each an independent zstandard frame with a content checksum, holding whole documents' ids
  (little-endian unsigned 32-bit) up to about ``FRAME_BYTES``; a longer document has frames of its own;
* a skippable frame with the document table (zstandard over doc_id, n_tokens, has_id columns);
* a skippable frame with the seek table: compressed size, plain size and low 32 bits of XXH64 of every frame,
  then the number of frames, a flag byte and the seekable-format magic.  The layout of this last frame is the
  public seekable format, and plain ``zstd -d`` gives the id stream.

A reader fetches the last bytes, the document table and only the frames of the documents it wants.

Rows: a null text is an empty text (its document holds the end id alone).  Documents stand in ascending doc_id
order, null ids first; rows that share a doc_id stay separate and are ordered by text.  An empty table gives no
file and no row.  Other columns are ignored.  Files carry the task attempt in their names and only those named
in the committed manifest count, so retried or speculative tasks leave nothing behind that is read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.common import keep, scratch
from plumbline.llm.tokens import PieceEncoder

FRAME_BYTES = 1 << 18
SEEK_MAGIC = 0x8F92EAB1
SEEK_FRAME = 0x184D2A5E
TABLE_FRAME = 0x184D2A50
CHECKSUM_FLAG = 0x80
BATCH_BYTES = 1 << 20


def file_system(path: str):
    """(file system, path in it) of a URI or absolute path, as tasks see it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one shard; ``add`` takes documents in order."""

    def __init__(self, stream, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.pending: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self.flush()
        self.docs.append((doc_id or 0, len(ids) // 4, doc_id is not None))
        for at in range(0, len(ids), self.frame_bytes):
            piece = ids[at:at + self.frame_bytes]
            self.pending.append(piece)
            self.size += len(piece)
            if self.size >= self.frame_bytes:
                self.flush()

    def flush(self) -> None:
        if self.size:
            plain = b"".join(self.pending)
            packed = self.compressor.compress(plain)
            self.stream.write(packed)
            self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = np.array(self.docs, np.int64).reshape(-1, 3)
        plain = b"".join(np.ascontiguousarray(table[:, i]).astype("<i8").tobytes() for i in range(3))
        packed = self.compressor.compress(plain)
        self.stream.write(struct.pack("<II", TABLE_FRAME, len(packed)) + packed)
        self.frames.append((len(packed) + 8, 0, xxhash.xxh64_intdigest(packed) & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SEEK_FRAME, len(entries) + len(footer)) + entries + footer)


class ShardReader:
    """Random access to one shard; ``source`` is a seekable file object."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 9)
        n, flag, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        source.seek(size - 9 - 12 * n)
        self.frames = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.plain_at = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        source.seek(int(self.at[n - 1]) + 8)
        packed = source.read(int(self.frames[n - 1, 0]) - 8)
        if xxhash.xxh64_intdigest(packed) & 0xFFFFFFFF != self.frames[n - 1, 2]:
            raise ValueError("damaged document table")
        table = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i8").reshape(3, -1)
        self.doc_id, self.n_tokens, self.has_id = table
        self.start = np.concatenate([[0], np.cumsum(self.n_tokens)])
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.source.seek(int(self.at[k]))
            plain = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.frames[k, 0])))
            if len(plain) != self.frames[k, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"damaged frame {k}")
            self.last = (k, plain)
        return self.last[1]

    def ids(self, i: int) -> bytes:
        """Ids of the i-th document; touches only the frames it lies in."""
        lo, hi = int(self.start[i]) * 4, int(self.start[i + 1]) * 4
        first = int(np.searchsorted(self.plain_at, lo, "right")) - 1
        out = []
        for k in range(first, len(self.frames)):
            base = int(self.plain_at[k])
            if base >= hi:
                break
            out.append(self.frame(k)[max(0, lo - base):hi - base])
        return b"".join(out)


def _write_shards(folder: str, end_id: int, vocabulary: str | None) -> Callable:
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = stream = None
        context = TaskContext.get()
        shard = context.partitionId()
        system, base = file_system(folder)
        name = f"shard-{shard:06d}-{context.taskAttemptId()}.ids.zst"
        encoder = PieceEncoder(vocabulary)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system.create_dir(base, recursive=True)
                stream = system.open_output_stream(f"{base}/{name}", compression=None)
                writer = ShardWriter(stream)
            texts = batch.column(1).cast(pa.large_binary())
            for row in range(0, batch.num_rows, 256):
                found = encoder.encode_all(texts.slice(row, 256).to_pylist())
                for doc_id, ids in zip(batch.column(0).slice(row, 256).to_pylist(), found, strict=True):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            stream.close()
            docs, tokens = len(writer.docs), sum(n for _, n, _ in writer.docs)
            yield pa.record_batch({"shard": pa.array([shard], pa.int64()), "path": [f"{folder}/{name}"],
                                   "n_docs": pa.array([docs], pa.int64()), "n_tokens": pa.array([tokens], pa.int64()),
                                   "n_frames": pa.array([len(writer.frames) - 1], pa.int64())})
    return run


def write_token_files(docs: DataFrame, folder: str, end_id: int = 2, vocabulary: str | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards of ``docs`` below ``folder``; the manifest: shard, path, n_docs, n_tokens, n_frames, first_token.

    Ranges of doc_id are dealt by a sampled range exchange, rows of one id further by a hash of the text, so a
    repeated id does not fill one task.  ``first_token`` is a running sum over shards (one row per shard).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    manifest = keep(ordered.mapInArrow(_write_shards(folder, end_id, vocabulary),
                                       "shard long, path string, n_docs long, n_tokens long, n_frames long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read_shards(wanted: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = file_system(row["path"])
                with system.open_input_file(path) as source:
                    yield from _documents(ShardReader(source), row["first_token"], row["doc_ids"] if wanted else None)
    return run


def _documents(shard: ShardReader, first_token: int, doc_ids: list[int] | None) -> Iterator[pa.RecordBatch]:
    places = range(len(shard.doc_id))
    if doc_ids is not None:
        places = np.flatnonzero(np.isin(shard.doc_id, doc_ids) & (shard.has_id == 1)).tolist()
    out: list[tuple] = []
    size = 0
    for i in places:
        ids = shard.ids(i)
        out.append((int(shard.doc_id[i]) if shard.has_id[i] else None, first_token + int(shard.start[i]),
                    int(shard.n_tokens[i]), ids))
        size += len(ids)
        if size > BATCH_BYTES:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, n_tokens, ids = zip(*rows, strict=True)
    return pa.record_batch({"doc_id": pa.array(doc_id, pa.int64()), "start": pa.array(start, pa.int64()),
                            "n_tokens": pa.array(n_tokens, pa.int64()), "ids": pa.array(ids, pa.binary())})


READ = "doc_id long, start long, n_tokens long, ids binary"


def read_token_files(manifest: DataFrame) -> DataFrame:
    """All documents of the shards in ``manifest``: doc_id, start, n_tokens, ids (binary); every checksum is tested."""
    tasks = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("path", "first_token").repartition(tasks * 4).mapInArrow(_read_shards(False), READ)


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Only the documents whose doc_id is in ``wanted`` (column doc_id); only their frames are decompressed.

    The shard index (one row per document, read from the document tables) is joined with ``wanted``, and the ids
    wanted of one shard come together, which a shard's own size bounds.
    """
    index = manifest.select("path", "first_token").mapInArrow(_read_index, "path string, first_token long, doc_id long")
    asked = (index.join(wanted.select("doc_id").distinct(), "doc_id").groupBy("path", "first_token")
             .agg(F.collect_set("doc_id").alias("doc_ids")))
    return asked.mapInArrow(_read_shards(True), READ)


def _read_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, path = file_system(row["path"])
            with system.open_input_file(path) as source:
                shard = ShardReader(source)
            n = len(shard.doc_id)
            yield pa.record_batch({"path": pa.array([row["path"]] * n, pa.string()),
                                   "first_token": pa.array([row["first_token"]] * n, pa.int64()),
                                   "doc_id": pa.array(shard.doc_id, mask=shard.has_id == 0)})


def token_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op1: doc_id, start, n_tokens, ids_crc32 of every document, taken from the files just written."""
    manifest = write_token_files(docs, scratch(spark, "token-files"))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
