"""Hard negatives: rows of another label that score nearly as high as an anchor's positives.

Vectors become whole numbers, so every score is exact.  Anchors stand in tiles and all rows in stripes; each pair of
a tile and a stripe is one group, whose scores come block by block from Strassen's recursive product of the two int64
matrices: odd sizes are padded with zeros, seven half-size products and whole-number additions replace eight, down to
``LEAF``.  Additions wrap at 64 bits, so a score is exact whenever it fits a long itself.

Nothing of the size of the score matrix is stored.  A group keeps per anchor a heap of its best positives, merged
block by block; Spark merges the heaps of all stripes (a ranked window that is cut before the shuffle).  The window of
scores that a positive allows is known only then, so a second pass makes the same products and keeps per anchor and
positive a heap of the best rows inside the window, merged in the same two steps.

Groups are bounded: ``TILE`` anchors, and stripes of at most about ``STRIPE`` rows dealt by row number.  The number of
stripes is at least ``LEAST_STRIPES``, so that small tables use more than one task.

Rows: a null label, vector or component, or one that is not finite, takes a row out.  Repeated rows are rows of their
own (a copy of an anchor is an anchor and may be its positive).  A null vec_id is no anchor and comes last among
equals.  Vectors of unequal length are filled up with zeros.  Anchors without positives give no rows, and a positive
without rows in its window gives none.  Further columns are ignored, whatever their names.  Components beyond 2^62 are
held there.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import keep

TILE = 1024             # anchors of a tile
STRIPE = 1 << 17        # rows of a stripe, about
LEAST_STRIPES = 24
BLOCK = 1024            # rows multiplied at once
LEAF = 16               # below this size rows are multiplied directly
_LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b for int64 matrices, exact modulo 2^64, by Strassen's seven products."""
    (n, d), m = a.shape, b.shape[1]
    if min(n, d, m) <= leaf:
        return a @ b
    if n % 2 or d % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, d % 2)))
        b = np.pad(b, ((0, d % 2), (0, m % 2)))
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = strassen(a12 - a22, b21 + b22, leaf) + p1 + p4 - p5
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = strassen(a21 - a11, b11 + b12, leaf) + p1 - p2 + p3
    return out[:n, :m]


class Heaps:
    """The best ``k`` scores of every line, with the place of each; the earlier of equal scores stays.

    ``merge`` takes places that all come after those taken before, so heaps merge in any grouping of blocks.
    """

    def __init__(self, lines: int, k: int):
        self.score = np.full((lines, k), _LEAST, np.int64)
        self.place = np.full((lines, k), -1, np.int64)

    def merge(self, scores: np.ndarray, allowed: np.ndarray, first_place: int) -> None:
        k = self.score.shape[1]
        worth = allowed & (scores > self.score[:, -1:])
        worth |= allowed & (self.place[:, -1:] < 0)
        lines = np.flatnonzero(worth.any(axis=1))
        if not len(lines):
            return
        new = np.where(worth[lines], scores[lines], _LEAST)
        places = np.where(worth[lines], first_place + np.arange(scores.shape[1]), -1)
        if new.shape[1] > k:  # the k best of the block first, the earlier of equals
            least = np.partition(new, -k, axis=1)[:, [-k]]
            over, equal = new > least, new == least
            take = over | equal & (np.cumsum(equal, axis=1) <= k - over.sum(axis=1, keepdims=True))
            at = np.nonzero(take)[1].reshape(len(lines), k)
            new, places = np.take_along_axis(new, at, 1), np.take_along_axis(places, at, 1)
        new = np.hstack([self.score[lines], new])
        places = np.hstack([self.place[lines], places])
        # an empty place ranks below every score, also below the least number
        order = np.lexsort((~new, places < 0), axis=1)[:, :k]
        self.score[lines] = np.take_along_axis(new, order, 1)
        self.place[lines] = np.take_along_axis(places, order, 1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of longs as rows of one matrix, shorter ones filled up with zeros."""
    lists = column.combine_chunks()
    bounds = np.asarray(lists.offsets)
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(bounds)
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return values[bounds[0]:bounds[-1]].reshape(len(sizes), wide).astype(np.int64)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = values[bounds[0]:bounds[-1]]
    return out


def _sorted_rows(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("id", "ascending"), ("uid", "ascending")])  # null ids last


def _products(anchors: pa.Table, rows: pa.Table):
    """(scores, first place, label, uid) of every block of rows."""
    left, right = _matrix(anchors["v"]), _matrix(rows["v"])
    wide = max(left.shape[1], right.shape[1])
    left, right = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (left, right))
    labels = rows["label"].to_numpy()
    uids = rows["uid"].to_numpy()
    for at in range(0, len(right), BLOCK):
        yield strassen(left, right[at:at + BLOCK].T), at, labels[at:at + BLOCK], uids[at:at + BLOCK]


def _found(heaps: Heaps, rows: pa.Table, columns: dict[str, pa.Array]) -> pa.Table:
    line, slot = np.nonzero(heaps.place >= 0)
    place = heaps.place[line, slot]
    return pa.table({k: v.take(pa.array(line)) for k, v in columns.items()} | {
        "uid": rows["uid"].combine_chunks().take(pa.array(place)),
        "id": rows["id"].combine_chunks().take(pa.array(place)),
        "score": pa.array(heaps.score[line, slot])})


def _positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = _sorted_rows(rows)
        own, labels = anchors["uid"].to_numpy()[:, None], anchors["label"].to_numpy()[:, None]
        heaps = Heaps(len(own), k)
        for scores, at, label, uid in _products(anchors, rows):
            heaps.merge(scores, (labels == label) & (own != uid), at)
        return _found(heaps, rows, {"anchor_uid": anchors["uid"].combine_chunks()})
    return run


def _windows(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = _sorted_rows(rows)
        asked = anchors["windows"].combine_chunks()
        line = np.asarray(asked.value_parent_indices())
        windows = asked.flatten()
        low, high = (windows.field(x).to_numpy(zero_copy_only=False) for x in ("low", "high"))
        labels = anchors["label"].to_numpy()[:, None]
        heaps = Heaps(len(line), k)
        step = max(1, (1 << 21) // BLOCK)  # lines of a window heap taken at once
        for scores, at, label, _ in _products(anchors, rows):
            scores, other = np.ascontiguousarray(scores), labels != label
            for n in range(0, len(line), step):
                part = slice(n, n + step)
                own = scores[line[part]]
                inside = (own >= low[part, None]) & (own <= high[part, None]) & other[line[part]]
                view = Heaps.__new__(Heaps)
                view.score, view.place = heaps.score[part], heaps.place[part]
                view.merge(own, inside, at)
        return _found(heaps, rows, {"anchor_uid": anchors["uid"].combine_chunks().take(pa.array(line)),
                                    "nth": windows.field("nth")})
    return run


def whole_numbers(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
                  label_col: str = "label") -> DataFrame:
    """uid, id, label, v: the rows that take part, their components times ``scale`` rounded down."""
    most = float(1 << 62)
    usable = F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall(
        "x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("x"))
            .where(usable)
            .select(F.monotonically_increasing_id().alias("uid"), "id", "label",
                    F.transform("x", lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-most)), F.lit(most))))
                    .alias("v")))


def _merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The heaps of all stripes as one: score descending, then id (null last), then row."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    return found.withColumn("nth_best", F.row_number().over(order)).where(F.col("nth_best") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, tile: int = TILE, stripe: int = STRIPE,
                   least_stripes: int = LEAST_STRIPES) -> DataFrame:
    """Per anchor and positive up to ``negatives`` rows of other labels whose score s has
    low * p <= 100 * s <= high * p, p being the positive's score.

    ``rows`` has uid (unique), id, label and v (array<long>), as from ``whole_numbers``; ``anchors`` is a condition
    on them.  Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and the uids.
    """
    rows = keep(rows, "vectors")
    number, chosen = rows.agg(F.count(F.lit(1)), F.count_if(anchors)).first()
    stripes = max(least_stripes, -(-number // stripe))
    tiles = max(1, -(-chosen // tile))
    deal = F.pmod(F.xxhash64("uid"), F.lit(tiles)).cast("int")
    query = rows.where(anchors).withColumn("tile", deal)
    every = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe")
    again = [F.col(x).alias(x) for x in rows.columns]  # columns of their own, as the anchors are rows too
    held = (rows.select(*again).withColumn("stripe", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(stripes)).cast("int"))
            .select("*", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
            .groupBy("tile", "stripe"))

    def scored(asked: DataFrame, work: Callable, schema: str) -> DataFrame:
        return asked.select("*", every).groupBy("tile", "stripe").cogroup(held).applyInArrow(
            lambda a, b: work(a, b) if len(a) and len(b) else _none(schema), schema)

    best = keep(_merged(scored(query, _positives(positives), "anchor_uid long, uid long, id long, score long"),
                        ["anchor_uid"], positives)
                .select("anchor_uid", F.col("nth_best").alias("nth"), F.col("uid").alias("positive_uid"),
                        F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # whole-number bounds of the window; decimals, as 90 * p may pass 64 bits
    p = F.col("positive_score").cast("decimal(38,0)")
    bounds = best.select(
        "anchor_uid", "nth", F.ceil(p * low / 100).cast("long").alias("low"), F.floor(p * high / 100).cast("long").alias("high"))
    windows = bounds.groupBy("anchor_uid").agg(F.sort_array(F.collect_list(F.struct("nth", "low", "high"))).alias("windows"))
    asked = query.join(windows, query["uid"] == windows["anchor_uid"]).drop("anchor_uid")
    near = _merged(scored(asked, _windows(negatives), "anchor_uid long, nth int, uid long, id long, score long"),
                   ["anchor_uid", "nth"], negatives)
    names = rows.select(*again).where(anchors).select(F.col("uid").alias("anchor_uid"), F.col("id").alias("anchor_id"))
    return near.join(best, ["anchor_uid", "nth"]).join(names, "anchor_uid").select(
        "anchor_id", "positive_id", F.col("nth_best").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"), "anchor_uid", "positive_uid", F.col("uid").alias("negative_uid"))


def _none(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))]).empty_table()


def hard_negative_table(embeddings: DataFrame) -> DataFrame:
    """op11: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = whole_numbers(embeddings)
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
