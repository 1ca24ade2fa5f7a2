"""Vector best-fit packing of token sequences.

A bin (sequence) has three capacities: tokens, documents and attention cost (the sum of squared lengths).  Pieces
are taken longest first; each goes into the open bin that the chosen score prefers among those where all three
residuals stay non-negative, and a new bin opens only when none fits.  Scores over capacities scaled to one and
weighted: ``norm`` takes the least residual norm after placing, ``dot`` the largest product of need and residual.

All three needs follow from a piece's length, so pieces of one length are alike: the placement is worked out on
the histogram of lengths (never more rows than the token capacity) for whole groups of equal bins at once, with
the same result as piece by piece.  Spark tokenizes, counts, ranks the pieces of each length across tasks and
gives every piece its bin from its rank; no text, id or document passes the driver, and no group is gathered.

Rows: null text is empty text (the end id alone, one piece).  Rows repeating a doc_id are separate documents.
An empty table gives no pieces.  Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.common import keep
from plumbline.llm.tokens import PieceEncoder


@dataclass(frozen=True)
class Capacity:
    """Most tokens, documents and attention cost of a sequence; None: what the tokens allow at most."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def _tokenize(size: int, end_id: int, vocabulary: str | None) -> Callable:
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = PieceEncoder(vocabulary), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for row in range(0, batch.num_rows, 256):
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "rank")}
                found = encoder.encode_all(texts.slice(row, 256).to_pylist())
                for doc_id, ids in zip(batch.column(0).slice(row, 256).to_pylist(), found, strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        part_ids = ids[at:at + 4 * size]
                        n = len(part_ids) // 4
                        for k, v in zip(out, (doc_id, piece, at // 4, n, part_ids, seen[n]), strict=True):
                            out[k].append(v)
                        seen[n] += 1
                yield pa.record_batch(
                    {"doc_id": pa.array(out["doc_id"], pa.int64()), "piece": pa.array(out["piece"], pa.int32()),
                     "start": pa.array(out["start"], pa.int64()), "length": pa.array(out["length"], pa.int64()),
                     "ids": pa.array(out["ids"], pa.binary()),
                     "part": pa.array([part] * len(out["rank"]), pa.int32()),
                     "rank": pa.array(out["rank"], pa.int64())})
    return run


def tokenized_pieces(docs: DataFrame, size: int = 2048, end_id: int = 0, vocabulary: str | None = None,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``size`` ids, with its rank among its task's pieces of that length; written."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return keep(rows.mapInArrow(
        _tokenize(size, end_id, vocabulary),
        "doc_id long, piece int, start long, length long, ids binary, part int, rank long"), "pieces")


def place(histogram: dict[int, int], capacity: Capacity, score: str = "norm",
          weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Runs of placements: length, first rank, number of pieces, first bin, pieces per bin, offset in the bin.

    The pieces of a length ranked ``first rank`` onwards fill bins ``first bin`` onwards, so many to a bin.
    """
    full = capacity.vector()
    weight = np.array(weights) / full
    room = np.empty((0, 3), np.int64)   # residuals of each group of equal open bins
    count = np.empty(0, np.int64)
    first = np.empty(0, np.int64)
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        shortest = np.array([1, 1, 1], np.int64)
        usable = (room >= shortest).all(axis=1)
        room, count, first = room[usable], count[usable], first[usable]
        while left:
            fits = (room >= need).all(axis=1)
            if fits.any():
                at = np.flatnonzero(fits)
                if score == "norm":
                    after = ((room[at] - need) * weight)
                    g = at[np.argmin((after * after).sum(axis=1))]
                    most = int((room[g] // need).min())  # a bin just filled stays the best one
                else:
                    g = at[np.argmax((room[at] * weight) @ (need * weight))]
                    most = 1                             # its fellows score higher than a bin just filled
                base, many, start = room[g].copy(), int(count[g]), int(first[g])
                keep_rows = np.arange(len(count)) != g
                room, count, first = room[keep_rows], count[keep_rows], first[keep_rows]
            else:
                most = int((full // need).min())
                base, many, start = full.copy(), -(-left // most), bins
                bins += many
            groups = []
            whole = min(many, left // most)
            if whole:
                runs.append((length, rank, whole * most, start, most, int(full[0] - base[0])))
                rank, left = rank + whole * most, left - whole * most
                groups.append((base - most * need, whole, start))
            if left and whole < many:
                runs.append((length, rank, left, start + whole, left, int(full[0] - base[0])))
                groups.append((base - left * need, 1, start + whole))
                rank, left, whole = rank + left, 0, whole + 1
            if whole < many:
                groups.append((base, many - whole, start + whole))
            room = np.vstack([room, *(x[None] for x, _, _ in groups)])
            count = np.append(count, [n for _, n, _ in groups])
            first = np.append(first, [s for _, _, s in groups])
    return np.array(runs, np.int64).reshape(-1, 6)


def _assign(runs: np.ndarray) -> Callable:
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    table = runs[order]
    lengths = np.unique(table[:, 0])
    lo = np.searchsorted(table[:, 0], lengths)
    hi = np.append(lo[1:], len(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = np.empty(len(length), np.int64)
            for value in np.unique(length):
                k = np.searchsorted(lengths, value)
                own = length == value
                row[own] = lo[k] + np.searchsorted(table[lo[k]:hi[k], 1], rank[own], "right") - 1
            found = table[row]
            within = rank - found[:, 1]
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("part", "rank")}
            yield pa.record_batch(columns | {
                "sequence_id": pa.array(found[:, 3] + within // found[:, 4]),
                "offset": pa.array(found[:, 5] + within % found[:, 4] * length)})
    return run


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), score: str = "norm",
         weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """``pieces`` of ``tokenized_pieces`` with sequence_id and offset; further columns (ids) come along."""
    per_task = pieces.groupBy("part", "length").agg(F.max("rank").alias("last")).select(
        "part", "length", (F.col("last") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # at most one row per length, that is the token capacity
    histogram = {x["length"]: x["n"] for x in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = place(histogram, capacity, score, weights)
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name not in ("part", "rank"))
    return ranked.mapInArrow(_assign(runs), f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame) -> DataFrame:
    """op2: per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The contract limits tokens only, so documents and attention cost get the capacities that 2048 tokens imply;
    they still take part in the score.
    """
    pieces = tokenized_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
