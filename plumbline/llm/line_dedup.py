"""Line deduplication with content-defined chunks of lines.

Every non-empty line is hashed.  The chunks are all runs of ``WIDTH`` neighbouring lines of a text, one beginning at
every line, so that whether a passage is found does not depend on what stands around it: the repeated chunks of a
repeated run of lines overlap and cover the whole run.  Chunks that occur again anywhere, in the same or another
document, are removed but for the first occurrence (least doc_id, then text hash, then position), after their bytes
were compared.  A text of one line is a chunk of its own, met by other such texts only, so that exact copies always
go whole; other single lines are never removed, and the first occurrence of every line stays.

With ``width=None`` chunks do not overlap: a rolling hash over the last ``ROLL`` line hashes ends a chunk where it is
a multiple of ``DIVISOR`` (after at least ``MIN_LINES`` lines, at the latest after ``MAX_LINES``); a last line left
alone joins the chunk before it.  This has fewer chunks but loses most short passages, as only chunks lying wholly inside a passage match; no query uses it.

Thin rows (digest and place of each chunk) are counted first; only documents holding a repeated digest send those
chunks' bytes, which are grouped by the bytes themselves, so a hash collision removes nothing.  Partial aggregation
handles digests that very many documents share, and what is removed is told by place, never by a join on a digest
group.

Rows: null and empty texts have no lines and stay as they are.  Rows with the same doc_id and text count as one
document and keep or lose the same chunks; rows with the same doc_id and different texts are different documents.
Null ids sort first.  An empty table gives no rows.  Other columns, whatever their names, travel inside ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plumbline.llm.common import U64, WordBlock, byte_table, keep, mix, ngrams, release, row_of_word, signed, word_blocks

WIDTH = 2
ROLL = 2
DIVISOR = 4
MIN_LINES = 2
MAX_LINES = 32


def chunk_bounds(lines: np.ndarray, roll: int = ROLL, divisor: int = DIVISOR, least: int = MIN_LINES,
                 most: int = MAX_LINES) -> list[int]:
    """Line numbers where chunks begin, with the number of lines as last entry, from one text's line hashes."""
    n = len(lines)
    if not n:
        return [0]
    rolled = mix(ngrams(lines, roll) + U64(roll)) if n >= roll else np.empty(0, np.uint64)
    ends = np.flatnonzero(rolled % U64(divisor) == 0) + roll  # a chunk ends before this line
    bounds, at = [0], 0
    while at < n:
        nearest = int(np.searchsorted(ends, at + least))
        at = min(n, at + most, int(ends[nearest]) if nearest < len(ends) else n)
        bounds.append(at)
    if len(bounds) > 2 and bounds[-1] - bounds[-2] == 1:  # a last line alone belongs to the chunk before it
        del bounds[-2]
    return bounds


def _runs(block: WordBlock, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of every run of ``width`` lines within a row; a shorter text is one run."""
    row, n = row_of_word(block), np.diff(block.first)
    first = np.flatnonzero(row[width - 1:] == row[:len(row) - width + 1]) if len(row) >= width else np.empty(0, np.int64)
    short = (n > 0) & (n < width)
    return np.append(first, block.first[:-1][short]), np.append(np.full(len(first), width), n[short])


def _parts(block: WordBlock, rule: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The same of the chunks between boundaries."""
    out = []
    for first, last in zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True):
        bounds = chunk_bounds(block.hash[first:last], **rule)
        out += [(first + a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)
                if b - a > 1 or last - first == 1]
    return tuple(np.array(out, np.int64).reshape(-1, 2).T)


def _chunks(width: int | None, **rule: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(b"\n", fold_case=False)
        for batch in batches:
            for block in word_blocks(batch.column("text"), table):
                at, n = _runs(block, width) if width else _parts(block, rule)
                if not len(at):
                    continue
                inner = np.empty(len(at), np.uint64)
                for k in np.unique(n).tolist():
                    inner[n == k] = ngrams(block.hash, k)[at[n == k]]
                row = row_of_word(block)[at]
                take = pa.array(block.row0 + row, pa.int64())
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").take(take), "h": batch.column("h").take(take),
                    "no": pa.array(at - block.first[row], pa.int32()),
                    "start": pa.array(block.start[at] - block.text[row], pa.int64()),
                    "size": pa.array(block.end[at + n - 1] - block.start[at], pa.int64()),
                    "lines": pa.array(n, pa.int32()),
                    "d1": pa.array(signed(mix(inner + n.astype(np.uint64)))),
                    "d2": pa.array(signed(mix(inner ^ mix(block.hash[at]))))})
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = byte_table(b"\n", fold_case=False)
    for batch in batches:
        texts, cuts = batch.column("text"), batch.column("cuts")
        lines = np.concatenate([np.diff(b.first) for b in word_blocks(texts, table)] or [np.empty(0, np.int64)])
        changed = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
        removed = np.zeros(len(texts), np.int64)
        kept = texts
        if len(changed):
            new = []
            for i in changed.tolist():
                spans = cuts[i].as_py()
                removed[i] = len({no for x in spans for no in range(x["no"], x["no"] + x["lines"])})
                new.append(cut_text(texts[i].as_py().encode(), [(x["start"], x["size"]) for x in spans]).decode())
            mask = np.zeros(len(texts), bool)
            mask[changed] = True
            kept = pa.compute.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
        yield pa.record_batch({"row": batch.column("row"), "kept_text": kept, "n_lines": pa.array(lines),
                               "n_removed_lines": pa.array(removed)})


def cut_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the spans (start, size) and one line end behind each; at the text's end the one before it.

    Spans may overlap; of two, the one that begins later also ends later.
    """
    out, at = [], 0
    for start, size in sorted(spans):
        out.append(text[at:start])
        at = start + size
        if text[at:at + 1] == b"\n":
            at += 1
    out.append(text[at:])
    kept = b"".join(out)
    return kept[:-1] if at >= len(text) and not text.endswith(b"\n") and kept.endswith(b"\n") else kept


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                width: int | None = WIDTH, **rule: int) -> DataFrame:
    """row, kept_text, n_lines, n_removed_lines of every row of ``docs``; ``rule`` is that of ``chunk_bounds``."""
    boxed = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"),
                        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    boxed = boxed.withColumn("h", F.xxhash64("text"))
    thin = boxed.select("doc_id", "h", "text")
    chunks = keep(thin.mapInArrow(_chunks(width, **rule), "doc_id long, h long, no int, start long, size long, "
                                                          "lines int, d1 long, d2 long"), "chunks")
    repeated = chunks.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = keep(chunks.join(repeated, ["d1", "d2"], "left_semi"), "repeated-chunks")
    release(docs.sparkSession, chunks)

    # the bytes of repeated chunks; a document's own chunks are bounded by its length
    mine = found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("no", "start", "size")).alias("chunks"))
    same = (F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.h") == F.col("c.h")))
    raw = F.col("text").cast("binary")
    pieces = (thin.alias("t").join(mine.alias("c"), same)
              .select("t.doc_id", "t.h", raw.alias("text"), F.explode("c.chunks").alias("c"))
              .select("doc_id", "h", "c.no", F.substring("text", F.col("c.start").cast("int") + 1,
                                                         F.col("c.size").cast("int")).alias("piece")))
    firsts = keep(pieces.groupBy("piece").agg(F.min(F.struct("doc_id", "h", "no")).alias("first")).select("first.*"),
                  "first-chunks")
    release(docs.sparkSession)
    is_first = (F.col("f.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("f.h") == F.col("p.h"))
                & (F.col("f.no") == F.col("p.no")))
    removed = (found.alias("f").join(firsts.alias("p"), is_first, "left_anti")
               .groupBy("doc_id", "h").agg(F.collect_set(F.struct("no", "start", "size", "lines")).alias("cuts")))
    # the text travels once, inside the row
    merged = (boxed.select("row", "doc_id", "h").alias("t").join(removed.alias("c"), same, "left")
              .select("t.row", F.col("t.row").getField(text_col).cast("string").alias("text"), "c.cuts"))
    schema = StructType([boxed.schema["row"], StructField("kept_text", StringType()), StructField("n_lines", LongType()),
                         StructField("n_removed_lines", LongType())])
    return merged.mapInArrow(_cut, schema)


def line_table(docs: DataFrame, width: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, kept_sha256 (of the kept text; of the empty text for null).

    op3 and the pipeline remove runs of ``WIDTH`` lines; without a width only chunks between boundaries go.
    """
    return dedup_lines(docs.select("doc_id", "text"), width=width).select(
        "row.doc_id", "n_lines", "n_removed_lines",
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
