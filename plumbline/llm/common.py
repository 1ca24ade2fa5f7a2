"""Shared pieces of the text operators: shared-folder tables, word scanning and hashing in Arrow batches.

Scanning works on the bytes of a whole Arrow column with numpy, so no Python object is made per word.
A null text is an empty text.  Word hashes are 64-bit sums of random byte values times powers of an odd
number; the tables come from a fixed seed, so every task and every run sees the same hashes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from plumbline.session import ensure_checkpoint_dir, release  # noqa: F401 - handed on to the operators

U64 = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_JOIN = 0xD6E8FEB86659FD93
SPACES = bytes([0x20, *range(0x09, 0x0E)])


# --- shared-folder tables ------------------------------------------------------------------------
def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files: cuts lineage, survives executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def import_path(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, whatever their working folder is."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    import_path(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def annotate(docs: DataFrame, prepare: Callable[[], Callable[[pa.Array], dict[str, pa.Array]]], fields: str,
             text_col: str = "text") -> DataFrame:
    """Add columns worked out from each row's whole text, in the same task and order: no shuffle.

    The result has the column ``row`` (a struct of all of ``docs``'s columns, so no name can clash) and
    ``fields``.  ``prepare`` runs once a task and gives the function applied to each Arrow column of texts.
    """
    boxed = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepare()
        for batch in batches:
            rows = batch.column(0)
            yield pa.record_batch({"row": rows} | work(rows.field(place).cast(pa.string())))

    schema = StructType([boxed.schema["row"], *_parse_datatype_string(fields).fields])
    return boxed.mapInArrow(run, schema)


# --- hashing -------------------------------------------------------------------------------------
def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the whole 64-bit word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(separators: bytes, fold_case: bool) -> np.ndarray:
    """Hash value of each byte; separators have 0, and with ``fold_case`` A-Z count as a-z."""
    table = _BYTE_VALUES.copy()
    if fold_case:
        table[0x41:0x5B] = table[0x61:0x7B]
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


_POWERS = np.array([1], dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 256, 2 * len(_POWERS))
        factors = np.full(size, _STEP, np.uint64)
        factors[0] = 1
        _POWERS = np.cumprod(factors, dtype=np.uint64)
    return _POWERS


def joined(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """Hash of two neighbouring runs of words; ``width`` is the right run's number of words."""
    return left * U64(pow(_JOIN, width, 2**64)) + right


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Unmixed hash of every run of k words, at the run's first word; len(words) - k + 1 values."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, width, power, span = None, 0, words, 1
    while True:  # runs of 1, 2, 4 ... words, put together as k's binary digits say
        if k & span:
            piece = power[width:width + n]
            out = piece if out is None else joined(out, piece, span)
            width += span
        if width == k:
            return out
        power = joined(power[:len(power) - span], power[span:], span)
        span *= 2


# --- words of an Arrow column --------------------------------------------------------------------
@dataclass
class WordBlock:
    """Words of the rows [row0, row1): byte bounds, hashes, and the index of each row's first word."""

    row0: int
    row1: int
    data: np.ndarray      # bytes of the block
    text: np.ndarray      # row1 - row0 + 1 byte bounds of the rows
    start: np.ndarray     # first byte of each word
    end: np.ndarray       # byte behind each word
    hash: np.ndarray      # mixed 64-bit hash of each word
    first: np.ndarray     # row1 - row0 + 1 word bounds of the rows


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 bounds) of a string or binary column, nulls empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)), bounds


def row_blocks(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row stands alone."""
    row, n = 0, len(bounds) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, min(to, n)
        row = min(to, n)


def words_of(data: np.ndarray, text: np.ndarray, table: np.ndarray, row0: int = 0, hashed: bool = True) -> WordBlock:
    inside = (table != 0)[data]
    rows = np.diff(text) > 0
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[text[:-1][rows]] = False
        after[text[1:][rows] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(0, np.uint64)
    if hashed and len(start):
        reach = np.diff(np.append(start, len(data)))
        place = np.arange(start[0], len(data)) - np.repeat(start, reach)
        longest = int((end - start).max())
        values = table[data[start[0]:]] * _powers(longest)[np.minimum(place, longest - 1)]
        hashes = mix(np.add.reduceat(values, start - start[0]) + (end - start).astype(np.uint64))
    return WordBlock(row0, row0 + len(text) - 1, data, text, start, end, hashes, np.searchsorted(start, text))


def word_blocks(column: pa.Array, table: np.ndarray, limit: int = 1 << 20) -> Iterator[WordBlock]:
    data, bounds = text_buffers(column)
    for row0, row1 in row_blocks(bounds, limit):
        lo, hi = int(bounds[row0]), int(bounds[row1])
        yield words_of(data[lo:hi], bounds[row0:row1 + 1] - lo, table, row0)


def row_of_word(block: WordBlock) -> np.ndarray:
    """Row (counted within the block) of each word."""
    return np.repeat(np.arange(block.row1 - block.row0), np.diff(block.first))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's signed long."""
    return np.ascontiguousarray(x).view(np.int64)


def covered(starts: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Mask of the n places that lie in any run [start, start + width)."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + width, n), -1)
    return np.cumsum(marks[:n]) > 0


# --- connected components ------------------------------------------------------------------------
def components(links: DataFrame) -> DataFrame:
    """(node, component) of undirected ``links`` a, b of longs; component is the smallest node reached.

    Each round hands every node and its larger neighbours to the smallest node it knows (both halves of the
    round aggregate minima before shuffling, so a node with very many neighbours is collected nowhere).  The
    list of links never grows and the rounds grow with the logarithm of the longest path.
    """
    state = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .distinct(), "links")
    before = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        old, state = state, keep(large.join(small, "a").where("b <> m")
                     .select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
                     .unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "links")
        release(state.sparkSession, old)
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # one row per node now, each pointing at its smallest node
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
