"""Ordered computations that never put a whole hot group into one task.

A plain window over (key, time) sorts every row of a key in one task.  Here each key is cut into
cells along the ordering axis; only one small row per cell meets the other cells of its key, and
the rows themselves are ordered inside their own cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.session import cut

c = F.col


def running_total(df: DataFrame, group: list[str], order: str, tie: str, value: Column, width: int,
                  name: str = "running") -> DataFrame:
    """Inclusive running sum of ``value`` along (order, tie) within ``group``.

    ``order`` is a whole number and ``width`` the cell length on that axis.
    """
    marked = df.withColumn("_cell", F.floor(c(order) / F.lit(width)).cast("bigint")).withColumn("_v", value)
    sums = marked.groupBy(*group, "_cell").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_cell").orderBy(order, tie).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (marked.withColumn("_local", F.sum("_v").over(inside))
            .join(offsets, [*group, "_cell"])
            .withColumn(name, c("_offset") + c("_local")).drop("_cell", "_v", "_local", "_offset"))


def _next_at_least(points: DataFrame, gap: int, width: int) -> DataFrame:
    """(key, at) -> the first ``at`` of the same key that is >= at + gap, where there is one."""
    cell = lambda col: F.floor(col / F.lit(width)).cast("bigint")
    hits = points.select("key", c("at").alias("t"), F.lit(0).alias("probe"), c("at").alias("hit"))
    probes = points.select("key", (c("at") + gap).alias("t"), F.lit(1).alias("probe"),
                           F.lit(None).cast("bigint").alias("hit"))
    both = hits.unionByName(probes).withColumn("cell", cell(c("t")))
    # the same cell: going down in time, hits before probes at equal times
    down = Window.partitionBy("key", "cell").orderBy(F.desc("t"), "probe").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = both.withColumn("near", F.min("hit").over(down))
    # later cells: one row per cell
    firsts = both.groupBy("key", "cell").agg(F.min("hit").alias("first"))
    later = Window.partitionBy("key").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    far = firsts.select("key", "cell", F.min("first").over(later).alias("far"))
    return (local.where(c("probe") == 1).join(far, ["key", "cell"])
            .select("key", (c("t") - gap).alias("at"), F.coalesce("near", "far").alias("to"))
            .where(c("to").isNotNull()))


def window_starts(requests: DataFrame, length: int, cells: int = 64) -> DataFrame:
    """First request of every back-to-back window per key (columns key, start).

    A window opens at the first request at or after the end of the previous one, so the starts form
    a chain through ``first request >= start + length``.  The chain is walked by doubling: each
    round joins the reached starts with jumps twice as long.
    """
    width = max(1, length // cells)
    points = requests.select("key", "at").distinct()
    jumps = cut(_next_at_least(points, length, width))
    # a request with a full window of silence before it surely opens one, so the walk starts at all
    # of those at once and only has to follow the dense stretches in between
    quiet = _next_at_least(points, 1, width).where(c("to") - c("at") >= length).select("key", c("to").alias("at"))
    reached = cut(requests.groupBy("key").agg(F.min("at").alias("at")).unionByName(quiet).distinct())
    known = reached.count()
    while True:
        landed = reached.join(jumps, ["key", "at"]).select("key", c("to").alias("at"))
        reached = cut(reached.unionByName(landed).distinct())
        size = reached.count()
        if size == known:
            return reached.withColumnRenamed("at", "start")
        known = size
        onward = jumps.select("key", c("at").alias("to"), c("to").alias("to2"))
        jumps = cut(jumps.join(onward, ["key", "to"]).select("key", "at", c("to2").alias("to")))


def window_cover(starts: DataFrame, length: int) -> DataFrame:
    """Windows (key, start) in the slots they touch: two slots as long as a window, whatever its requests.

    The copies are not in the size of the files of ``starts``, by which a broadcast would be chosen: the join shuffles.
    """
    slot = F.floor(c("start") / F.lit(length)).cast("bigint")
    return starts.select("key", "start", F.explode(F.array(slot, slot + 1)).alias("_slot")).hint("merge")


def assign_windows(requests: DataFrame, length: int, cells: int = 64) -> DataFrame:
    """Every request with its window's start and its position in it, by (at, event_id)."""
    width = max(1, length // cells)
    cover = window_cover(window_starts(requests, length, cells), length)
    placed = (requests.withColumn("_slot", F.floor(c("at") / F.lit(length)).cast("bigint"))
              .join(cover, ["key", "_slot"])
              .where((c("at") >= c("start")) & (c("at") < c("start") + length)).drop("_slot"))
    return running_total(placed, ["key", "start"], "at", "event_id", F.lit(1), width, "position")
