"""Removal of repeated word windows with prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document.  Every word covered by a window whose word sequence starts
anywhere else too (same document included) is removed, all occurrences alike, judged on the input.

1. Anchors: in each window the ``gram``-word sequence with the least hash.  Equal windows have the same one at the
   same place, so a window whose anchor occurs only once in the corpus cannot repeat; its suffix goes no further.
   Whole texts that occur more than once (equal 128-bit hashes) and hold a window lose everything; one of each group
   goes on, so that other documents meet it, and the others' suffixes need not.
2. Prefix partitioning: a suffix is coded by hashes of its leading blocks of words (8, 12 and 15 of the 35; depths
   8, 20, 35).  Suffixes are dealt by their 8-word prefix; a prefix that more than ``GROUP_ROWS`` suffixes share is
   replaced by the 20-word prefix, and that, if still too common, by the whole window, where nothing is left to
   compare and a count (with partial sums in every task) decides.  So every group fits a task's memory.
3. Subtrees: each task sorts its suffixes block by block, which is its subtrees' leaves in order with the depths of
   the branchings between neighbours.  Internal nodes at full depth are repeats; runs of neighbouring repeated
   windows of a document make up the maximal repeats.

Texts without words or shorter than a window keep everything.  Null text has no words.  Each row is a document of its
own: rows that repeat (same id and text) repeat each other's windows.  An empty table gives no rows.  Other columns,
whatever their names, travel inside ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plumbline.llm.common import (
    SPACES, U64, WordBlock, byte_table, covered, keep, mix, ngrams, release, row_of_word, signed, word_blocks,
)

WINDOW = 35
GRAM = 8
GROUP_ROWS = 200_000


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best() of every ``width`` neighbours, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = best(values[:len(values) - step], values[step:])
        span += step
    return values


def anchors_of(block: WordBlock, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows inside rows, hash of each window's anchor, places of all anchors)."""
    row = row_of_word(block)
    count = len(row) - window + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = row[:count] == row[window - 1:]
    grams = mix(ngrams(block.hash, gram)) | U64(1)
    reach = window - gram + 1
    least = np.where(inside, _sliding(grams, reach, np.minimum), U64(0))
    edge = np.zeros(reach - 1, np.uint64)
    places = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), reach, np.maximum) == grams)
    return np.flatnonzero(inside), least[inside], places


def depths(window: int, gram: int) -> tuple[int, int, int]:
    """Words in the short prefix, the middle prefix and the whole window."""
    return gram, gram + (window - gram) * 4 // 9, window


def _anchors(window: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(SPACES, fold_case=False)
        for batch in batches:
            for block in word_blocks(batch.column("text"), table):
                at = anchors_of(block, window, gram)[2]
                grams = (mix(ngrams(block.hash, gram)) | U64(1))[at]
                take = pa.array(block.row0 + row_of_word(block)[at])
                yield pa.record_batch({"doc_id": batch.column("doc_id").take(take), "h": batch.column("h").take(take),
                                       "gram": pa.array(signed(grams))})
    return run


def _suffixes(window: int, gram: int, text: int) -> Callable:
    short, middle, _ = depths(window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(SPACES, fold_case=False)
        for batch in batches:
            texts, found = batch.column("row").field(text), batch.column("found")
            for block in word_blocks(texts, table):
                starts, anchor, _ = anchors_of(block, window, gram)
                row = row_of_word(block)
                # a window's anchor is looked up among its row's repeated ones; neighbours mostly share it
                lists = found.slice(block.row0, block.row1 - block.row0)
                owner = np.repeat(np.arange(len(lists), dtype=np.uint64),
                                  lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                known = np.sort(mix(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + mix(owner + U64(1))))
                asked = mix(anchor + mix(row[starts].astype(np.uint64) + U64(1)))
                new = np.flatnonzero(np.append(True, asked[1:] != asked[:-1])[:len(asked)])
                place = np.minimum(np.searchsorted(known, asked[new]), max(len(known) - 1, 0))
                hit = known[place] == asked[new] if len(known) else np.zeros(len(new), bool)
                starts = starts[np.repeat(hit, np.diff(np.append(new, len(asked))))]
                first = mix(ngrams(block.hash, short))
                second = mix(ngrams(block.hash, middle - short))
                third = mix(ngrams(block.hash, window - middle))
                p1 = first[starts]
                p2 = mix(p1 + second[starts + short])
                p3 = mix(p2 + third[starts + middle])  # this one alone decides; 32 bits of the others deal and order
                rows = row[starts]
                yield pa.record_batch({
                    "cid": batch.column("cid").take(pa.array(block.row0 + rows)),
                    "pos": pa.array((starts - block.first[rows]).astype(np.int32)),
                    "p1": pa.array((p1 >> U64(32)).astype(np.uint32).view(np.int32)),
                    "p2": pa.array((p2 >> U64(32)).astype(np.uint32).view(np.int32)), "p3": pa.array(signed(p3))})
    return run


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves below internal nodes of full depth, of all prefix groups dealt to this task."""
    parts = [x for x in batches if x.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts)  # groups of at most GROUP_ROWS rows, a partition's worth in all
    p1, p2, p3 = (rows.column(x).to_numpy() for x in ("p1", "p2", "p3"))
    order = np.lexsort((p3, p2, p1))
    # depth, in blocks, to which each leaf agrees with the next: a branching of the subtree
    same1, same2, same3 = (x[order][1:] == x[order][:-1] for x in (p1, p2, p3))
    depth = same1.astype(np.int8) + (same1 & same2) + (same1 & same2 & same3)
    deep = depth == 3
    leaf = order[np.append(deep, False) | np.append(False, deep)]
    yield from rows.select(["cid", "pos"]).take(pa.array(leaf)).to_batches()


def _finish(window: int, text: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(SPACES, fold_case=False)
        for batch in batches:
            rows = batch.column("row")
            texts, starts = rows.field(text).cast(pa.large_binary()), batch.column("starts")
            copied = batch.column("copied").to_pylist()
            total, removed, kept = [], [], []
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").split()
                total.append(len(words))
                cut = starts[i].as_py()
                if copied[i] and len(words) >= window:
                    removed.append(len(words))
                    words = []
                elif cut:
                    gone = covered(np.array(cut, np.int64), window, len(words))
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.record_batch({"row": rows, "n_words": pa.array(total, pa.int64()),
                                   "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, n_words, n_removed, kept_text (kept words joined by one space) of every row of ``docs``."""
    place = docs.columns.index(text_col)
    boxed = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"),
                        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"))
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    anchors = thin.withColumn("h", F.xxhash64("text")).mapInArrow(
        _anchors(window, gram), "doc_id long, h long, gram long")
    repeated = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    hashes = thin.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"))
    copies = hashes.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    flags = hashes.join(copies, ["h", "h2"]).select(
        "doc_id", "h", F.lit(None).cast("long").alias("gram"), F.col("doc_id").eqNullSafe(F.col("least")).alias("first"))
    # anchors of one document are bounded by its length; ``first`` is null for texts without a copy
    mine = keep(anchors.join(repeated, "gram", "left_semi").select("doc_id", "h", "gram", F.lit(None).cast("boolean").alias("first"))
                .unionByName(flags).groupBy("doc_id", "h").agg(F.collect_set("gram").alias("found"),
                                                               F.bool_or("first").alias("first")), "repeated-anchors")
    release(docs.sparkSession)
    same = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.h") == F.col("c.h"))
    work = keep(boxed.alias("t").join(mine.alias("c"), same, "left").select("t.row", "c.found", "c.first")
                .withColumn("cid", F.monotonically_increasing_id()), "documents")
    release(docs.sparkSession, mine)

    anchored = F.coalesce(F.size("found") > 0, F.lit(False))
    suffixes = work.where(anchored & F.coalesce("first", F.lit(True))).mapInArrow(
        _suffixes(window, gram, place), "cid long, pos int, p1 int, p2 int, p3 long")
    # 65,536 coarse counts tell whether a prefix can be too common at all; only those of full buckets are counted
    bucket = F.col("p1").bitwiseAND(0xFFFF)
    full_buckets = keep(suffixes.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
                        .where(F.col("n") > group_rows).select("bucket"), "full-buckets")
    if full_buckets.isEmpty():
        crowded = full_buckets
    else:
        crowded = keep(suffixes.join(full_buckets, bucket == F.col("bucket"), "left_semi").groupBy("p1")
                       .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
                       .select("p1", F.lit(True).alias("longer")), "common-prefixes")
    if crowded.isEmpty():
        repeats = suffixes.repartition("p1").mapInArrow(_subtrees, "cid long, pos int")
    else:
        flagged = suffixes.join(crowded, "p1", "left")
        longer = flagged.where("longer")
        full = keep(longer.groupBy("p2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
                    .select("p2", F.lit(True).alias("full")), "common-prefixes")
        flagged = flagged.join(full, "p2", "left")
        dealt = flagged.where("full IS NULL").withColumn("prefix", F.when(F.col("longer"), F.col("p2"))
                                                         .otherwise(F.col("p1")))
        windows = flagged.where("full")
        twice = windows.groupBy("p3").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("p3")
        repeats = (dealt.repartition("prefix").select("cid", "pos", "p1", "p2", "p3")
                   .mapInArrow(_subtrees, "cid long, pos int")
                   .unionByName(windows.join(twice, "p3", "left_semi").select("cid", "pos")))
    starts = repeats.groupBy("cid").agg(F.collect_list("pos").alias("starts"))
    judged = anchored & F.col("first").isNull()
    affected = work.where(judged).join(starts, "cid", "left").select("row", "starts", F.lit(False).alias("copied"))
    rest = work.where(~judged).select("row", F.lit(None).cast("array<int>").alias("starts"),
                                      F.col("first").isNotNull().alias("copied"))
    schema = StructType([boxed.schema["row"], StructField("n_words", LongType()), StructField("n_removed", LongType()),
                         StructField("kept_text", StringType())])
    return rest.unionByName(affected).mapInArrow(_finish(window, place), schema)


def repeat_table(docs: DataFrame) -> DataFrame:
    """op8: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
