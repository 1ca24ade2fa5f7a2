"""Benchmark decontamination by winnowing.

A window is ``n`` consecutive words of a benchmark item (A-Z folded; an item with fewer words is one window).
Of the k-grams in each window the one with the least hash is kept as its fingerprint, in items and documents
alike, so a document that holds a window also holds its fingerprint: with k-grams of ``n - slide + 1`` words
every shared span of n words is found.  Windows whose fingerprint occurs in the benchmark are then extended:
the whole window must have the same hash as an item's window.

The benchmark's windows are counted first.  Up to ``broadcast_windows`` they go to every task and documents are
scanned without any shuffle; beyond, fingerprints and then windows meet in shuffle joins, with the same result.

Rows: null or wordless texts have no words and no hits.  Items without words are ignored, items repeating an id
count once, a null id counts as the empty string.  Documents that repeat (same id and text) get the same verdict
each.  Empty tables give no rows or no hits.  Other columns, whatever their names, travel inside ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import (
    U64, WordBlock, annotate, byte_table, covered, mix, ngrams, row_of_word, signed, word_blocks,
)

WINDOW = 10
SLIDE = 6
BROADCAST_WINDOWS = 1_000_000
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
FIELDS = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _table() -> np.ndarray:
    return byte_table(_SEPARATORS, fold_case=True)


def _windows(block: WordBlock, n: int, slide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, fingerprint, hash) of every n-word window inside one row."""
    row = row_of_word(block)
    count = len(row) - n + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    at = np.flatnonzero(row[:count] == row[n - 1:])
    grams = mix(ngrams(block.hash, n - slide + 1))
    least, span = grams, 1
    while span < slide:  # sliding minimum by doubling
        step = min(span, slide - span)
        least = np.minimum(least[:len(least) - step], least[step:])
        span += step
    return at, least[at], mix(ngrams(block.hash, n) + U64(n))[at]


def _short(block: WordBlock, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``width`` words inside one row."""
    row = row_of_word(block)
    count = len(row) - width + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(row[:count] == row[width - 1:])
    return at, mix(ngrams(block.hash, width) + U64(width))[at]


def _item_windows(n: int, slide: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        for batch in batches:
            for block in word_blocks(batch.column(1), table):
                ids = batch.column(0).slice(block.row0, block.row1 - block.row0)
                row = row_of_word(block)
                parts = [(np.full(len(w[0]), n), *w) for w in [_windows(block, n, slide)]]
                words = np.diff(block.first)
                for width in np.unique(words[(words > 0) & (words < n)]).tolist():
                    at, found = _short(block, width)
                    whole = words[row[at]] == width
                    parts.append((np.full(int(whole.sum()), width), at[whole], found[whole], found[whole]))
                width, at, least, found = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.record_batch({"item": ids.take(pa.array(row[at])), "width": pa.array(width.astype(np.int32)),
                                       "fingerprint": pa.array(signed(least)), "window": pa.array(signed(found))})
    return run


def window_index(benchmark: DataFrame, n: int = WINDOW, slide: int = SLIDE, item_col: str = "item_id",
                 text_col: str = "text") -> DataFrame:
    """item, width, fingerprint, window of every benchmark window."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                            F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_item_windows(n, slide), "item string, width int, fingerprint long, window long")


class _Index:
    """Benchmark windows as sorted arrays."""

    def __init__(self, rows: pa.Table):
        width = rows.column("width").to_numpy()
        window = rows.column("window").to_numpy().view(np.uint64)
        codes = rows.column("item").combine_chunks().dictionary_encode()
        self.items = codes.dictionary.to_pylist()
        code = codes.indices.to_numpy().astype(np.int64)
        self.widths = np.unique(width)
        self.fingerprints = np.unique(rows.column("fingerprint").to_numpy().view(np.uint64))
        order = np.lexsort((code, window))
        self.window, self.code = window[order], code[order]

    def has(self, sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(sorted_values):
            return np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
        return sorted_values[at] == values


def _hits(block: WordBlock, index: _Index, n: int, slide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, width, hash) of the block's windows that are windows of the benchmark."""
    found = []
    for width in index.widths.tolist():
        if width == n:
            at, least, window = _windows(block, n, slide)
            if len(least):  # a fingerprint stands for several windows in a row: look each up once
                new = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
                near = np.repeat(index.has(index.fingerprints, least[new]), np.diff(np.append(new, len(least))))
                at, window = at[near], window[near]
        else:
            at, window = _short(block, width)
        same = index.has(index.window, window)
        found.append((at[same], np.full(int(same.sum()), width), window[same]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def _runs(at: np.ndarray, width: np.ndarray, n: int) -> list[dict[str, int]]:
    inside = np.concatenate([[False], covered(at, width, n), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]


def _scan(index_of: Callable[[], _Index], n: int, slide: int) -> Callable:
    def prepare() -> Callable[[pa.Array], dict[str, pa.Array]]:
        index, table = index_of(), _table()

        def work(texts: pa.Array) -> dict[str, pa.Array]:
            words = np.zeros(len(texts), np.int64)
            spans: list[list] = [[] for _ in range(len(texts))]
            items: list[list] = [[] for _ in range(len(texts))]
            for block in word_blocks(texts, table):
                counts = np.diff(block.first)
                words[block.row0:block.row1] = counts
                at, width, window = _hits(block, index, n, slide)
                row = row_of_word(block)[at]
                for r in np.unique(row).tolist():
                    own = row == r
                    spans[block.row0 + r] = _runs(at[own] - block.first[r], width[own], int(counts[r]))
                    seen = np.unique(window[own])
                    lo = np.searchsorted(index.window, seen, "left")
                    hi = np.searchsorted(index.window, seen, "right")
                    codes = np.unique(np.concatenate([index.code[a:b] for a, b in zip(lo, hi, strict=True)]))
                    items[block.row0 + r] = sorted(index.items[c] for c in codes)
            return {"n_words": pa.array(words), "spans": pa.array(spans, _SPANS), "items": pa.array(items, _ITEMS)}
        return work
    return prepare


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ITEMS = pa.list_(pa.string())


# --- benchmarks too large for every task ---------------------------------------------------------
def _fingerprint_rows(n: int, slide: int, widths: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        for batch in batches:
            for block in word_blocks(batch.column("text"), table):
                row = row_of_word(block)
                at, least, _ = _windows(block, n, slide)
                rows, values = [row[at]], [least]
                for width in widths:
                    at, window = _short(block, width)
                    rows.append(row[at])
                    values.append(window)
                # neighbouring windows mostly share their fingerprint
                rows, values = np.concatenate(rows), np.concatenate(values)
                new = np.append(True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1]))[:len(values)]
                take = pa.array(block.row0 + rows[new])
                yield pa.record_batch({"k1": batch.column("k1").take(take), "k2": batch.column("k2").take(take),
                                       "fingerprint": pa.array(signed(values[new]))})
    return run


def _window_rows(n: int, slide: int, widths: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        for batch in batches:
            for r in range(batch.num_rows):
                wanted = np.sort(np.array(batch.column("found")[r].as_py(), np.int64).view(np.uint64))
                for block in word_blocks(batch.column("text").slice(r, 1), table):
                    at, least, window = _windows(block, n, slide)
                    parts = [(at, window, np.full(len(at), n), least)]
                    for width in widths:
                        at, window = _short(block, width)
                        parts.append((at, window, np.full(len(at), width), window))
                    at, window, width, least = (np.concatenate(x) for x in zip(*parts, strict=True))
                    near = np.isin(least, wanted)
                    many = int(near.sum())
                    yield pa.record_batch({
                        "k1": batch.column("k1").take(pa.array([r] * many, pa.int64())),
                        "k2": batch.column("k2").take(pa.array([r] * many, pa.int64())),
                        "window": pa.array(signed(window[near])), "at": pa.array(at[near]),
                        "width": pa.array(width[near].astype(np.int32))})
    return run


def _finish() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        for batch in batches:
            texts = batch.column("text")
            words = np.concatenate([np.diff(b.first) for b in word_blocks(texts, table)] or [np.empty(0, np.int64)])
            spans = []
            for hits, n in zip(batch.column("hits").to_pylist(), words.tolist(), strict=True):
                at = np.array([h["at"] for h in hits or ()], np.int64)
                width = np.array([h["width"] for h in hits or ()], np.int64)
                spans.append(_runs(at, width, n) if len(at) else [])
            items = [sorted(x or ()) for x in batch.column("items").to_pylist()]
            yield pa.record_batch({"row": batch.column("row"), "n_words": pa.array(words),
                                   "spans": pa.array(spans, _SPANS), "items": pa.array(items, _ITEMS)})
    return run


def _by_shuffle(docs: DataFrame, index: DataFrame, n: int, slide: int, text_col: str) -> DataFrame:
    widths = [r["width"] for r in index.where(F.col("width") < n).select("width").distinct().collect()]  # below n rows
    boxed = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"),
                        F.col(text_col).cast("string").alias("text"))
    keyed = boxed.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))
    texts = keyed.select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    prints = texts.mapInArrow(_fingerprint_rows(n, slide, widths), "k1 long, k2 long, fingerprint long")
    found = (prints.join(index.select("fingerprint").distinct(), "fingerprint", "left_semi")
             .groupBy("k1", "k2").agg(F.collect_set("fingerprint").alias("found")))
    windows = (texts.join(found, ["k1", "k2"])
               .mapInArrow(_window_rows(n, slide, widths), "k1 long, k2 long, window long, at long, width int"))
    matched = windows.join(index.select("window", "item").distinct(), "window")
    per_text = matched.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "width")).alias("hits"),
                                               F.collect_set("item").alias("items"))
    schema = f"row {boxed.schema['row'].dataType.simpleString()}, {FIELDS}"
    return keyed.join(per_text, ["k1", "k2"], "left").select("row", "text", "hits", "items").mapInArrow(_finish(), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, slide: int = SLIDE,
                  broadcast_windows: int = BROADCAST_WINDOWS, item_col: str = "item_id",
                  text_col: str = "text") -> DataFrame:
    """row, n_words, spans (hit words as [start, end) word numbers), items (sorted ids), n_hit, contaminated."""
    index = window_index(benchmark, n, slide, item_col)
    if index.limit(broadcast_windows + 1).count() <= broadcast_windows:
        shared = docs.sparkSession.sparkContext.broadcast(index.toArrow())
        found = annotate(docs, _scan(lambda: _Index(shared.value), n, slide), FIELDS, text_col)
    else:
        found = _by_shuffle(docs, index, n, slide, text_col)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", F.col("n_hit") > 0)


def contamination_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op9: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination(docs.select("doc_id", "text"), benchmark).select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
