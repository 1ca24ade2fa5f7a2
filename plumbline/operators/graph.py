"""Wall networks and room faces for all pages at once.

Segments are ``page_id, x1, y1, x2, y2``.  Every neighbour search is an equality join on grid cells;
the fixed-point jobs cut their lineage with reliable checkpoints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plumbline.functions import geometry as G
from plumbline.session import cut, release

c = F.col
SNAP = 1.5
CELL = 50.0


def cells(lo: Column, hi: Column, size: float) -> Column:
    """Grid indices covered by an interval."""
    return F.sequence(F.floor(lo / size).cast("bigint"), F.floor(hi / size).cast("bigint"))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("bigint")


def spread(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """One row per grid cell touched by a box (columns _cx, _cy).

    The planner overlooks these copies and would broadcast them by the size of the files they come from: joins shuffle them.
    """
    return (df.withColumn("_cx", F.explode(cells(x0, x1, size)))
            .withColumn("_cy", F.explode(cells(y0, y1, size)))).hint("merge")


# --- components (J2) -----------------------------------------------------------------------------
def components(edges: DataFrame, place: str | None = None) -> DataFrame:
    """(node, component) for undirected ``edges`` = a, b; the component is its smallest node.

    ``place`` is an expression on ``a`` that the nodes of most components share, such as their page: edges are
    dealt by it and joined up within bounded batches first, so the rounds only see what several batches tore apart.
    """
    if place is not None:
        return _placed_components(edges, place)
    return _component_rounds(edges)


def _component_rounds(edges: DataFrame) -> DataFrame:
    """Alternates two rewrites until nothing moves: every node hands its larger neighbours, then its
    smaller ones, to the smallest node it knows.  The edge list never grows, and the minimum per node
    is combined before the shuffle, so a node with very many neighbours is not collected anywhere.
    """
    spark = edges.sparkSession
    state = cut(edges.where(c("a") != c("b")).select("a", "b").distinct())
    mark = None
    while True:
        both = state.unionByName(state.select(c("b").alias("a"), c("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(c("b") > c("a")).join(least, "a").select(c("b").alias("a"), c("m").alias("b")).where(
            c("a") != c("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        old, state = state, cut(down.join(small, "a").where(c("b") != c("m")).select(c("b").alias("a"), c("m").alias("b"))
                                .unionByName(small.select("a", c("m").alias("b"))).distinct())
        del both, least, large, down, small
        release(spark, old)
        # count and an order-free digest of the edge list decide whether anything moved
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = state.select(c("b").alias("node"), c("b").alias("component")).distinct()
    return state.select(c("a").alias("node"), c("b").alias("component")).unionByName(roots)


def _join_up(batch_rows: int):
    """Arrow batches of edges (a, b) -> (node, root): each batch of edges joined up, the root its smallest node."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        def forest(rows: list) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            n = table.num_rows
            both = pa.concat_arrays([x for name in ("a", "b") for x in table.column(name).chunks])
            keys = both.flatten() if pa.types.is_struct(both.type) else [both]
            names = [str(i) for i in range(len(keys))]
            place = pa.compute.sort_indices(pa.table(dict(zip(names, keys))), [(x, "ascending") for x in names]).to_numpy()
            new = np.zeros(2 * n, bool)
            for key in keys:
                if pa.types.is_floating(key.type):
                    v = key.to_numpy(zero_copy_only=False)[place]
                    new[1:] |= (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
                else:
                    v = key.dictionary_encode().indices.to_numpy(zero_copy_only=False)[place]
                    new[1:] |= v[1:] != v[:-1]
            rank = np.empty(2 * n, np.int64)
            rank[place] = np.cumsum(new)
            first = place[np.flatnonzero(np.concatenate([[True], new[1:]]))]
            x, y = rank[:n], rank[n:]
            root = np.arange(len(first))
            while True:
                lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
                if (lo == hi).all():
                    break
                np.minimum.at(root, hi, lo)
                while not np.array_equal(root, root[root]):
                    root = root[root]
            return pa.record_batch({"node": both.take(pa.array(first)), "root": both.take(pa.array(first[root]))})

        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= batch_rows:
                yield forest(held)
                held, count = [], 0
        if held:
            yield forest(held)
    return run


def _placed_components(edges: DataFrame, place: str, batch_rows: int = 1 << 18) -> DataFrame:
    """Components of edges dealt by place.  Batches give each node a root; a node of several roots links them."""
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    schema = StructType([StructField("node", kind), StructField("root", kind)])
    # rows of a place lie side by side, so that a batch tears apart no more than the places at its ends
    dealt = edges.where(c("a") != c("b")).select("a", "b", F.expr(place).alias("_at")).repartition("_at").sortWithinPartitions(
        "_at").drop("_at")
    rows = cut(dealt.mapInArrow(_join_up(batch_rows), schema))
    torn = rows.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(c("lo") != c("hi"))
    links = cut(rows.join(torn, "node").where(c("root") != c("lo")).select(c("root").alias("a"), c("lo").alias("b")).distinct())
    if links.isEmpty():
        return rows.select("node", c("root").alias("component")).distinct()
    over = cut(_component_rounds(links))
    return (rows.join(over.select(c("node").alias("root"), "component"), "root", "left")
            .select("node", F.coalesce("component", "root").alias("component")).distinct())


# --- endpoint snapping (J1) -----------------------------------------------------------------------
def _ends(segs: DataFrame) -> DataFrame:
    return segs.withColumn("e", F.explode(F.array(
        F.struct(F.lit(1).alias("end"), c("x1").alias("x"), c("y1").alias("y")),
        F.struct(F.lit(2).alias("end"), c("x2").alias("x"), c("y2").alias("y"))))).select("page_id", "_sid", "e.*")


def _keyed(segs: DataFrame) -> DataFrame:
    """Distinct segments with a key made of their own coordinates."""
    xy = ["x1", "y1", "x2", "y2"]
    return segs.select("page_id", *xy).distinct().withColumn("_sid", F.struct(*xy))


def snap_segments(segs: DataFrame, snap: float = SNAP) -> DataFrame:
    """Endpoints within ``snap`` of each other move to their common centroid; zero lengths vanish.

    Points are first merged on a grid of a tenth of the radius, which also bounds how many points a
    search cell can hold.
    """
    micro = snap / 10
    ends = _ends(_keyed(segs)).withColumn("mx", F.round(c("x") / micro).cast("bigint")).withColumn(
        "my", F.round(c("y") / micro).cast("bigint"))
    points = cut(ends.groupBy("page_id", "mx", "my").agg(F.min(F.struct("x", "y")).alias("p")).select(
        "page_id", "mx", "my", "p.x", "p.y"))
    # a pair is looked for from its right point, so the left one may lie up to the radius (and a micro step) to the left
    size = 4 * snap
    here = points.withColumn("_cx", cell(c("x"), size)).withColumn("_cy", cell(c("y"), size))
    near = spread(points.select("page_id", c("mx").alias("nmx"), c("my").alias("nmy"), c("x").alias("nx"), c("y").alias("ny")),
                  c("nx") - snap, c("ny") - snap, c("nx") + micro, c("ny") + snap, size)
    pairs = here.join(near, ["page_id", "_cx", "_cy"]).where(
        ((c("mx") < c("nmx")) | ((c("mx") == c("nmx")) & (c("my") < c("nmy"))))
        & ((c("x") - c("nx")) * (c("x") - c("nx")) + (c("y") - c("ny")) * (c("y") - c("ny")) <= snap * snap))
    links = cut(pairs.select(F.struct("page_id", "mx", "my").alias("a"),
                             F.struct("page_id", c("nmx").alias("mx"), c("nmy").alias("my")).alias("b")))
    if links.isEmpty():
        moved = points.select("page_id", "mx", "my", c("x").alias("sx"), c("y").alias("sy"))
    else:
        comp = components(links, "a.page_id").select("node.page_id", "node.mx", "node.my", "component")
        member = cut(points.join(comp, ["page_id", "mx", "my"]))
        centre = member.groupBy("component").agg(F.avg("x").alias("sx"), F.avg("y").alias("sy"))
        placed = member.join(centre, "component").select("page_id", "mx", "my", "sx", "sy")
        moved = points.join(placed, ["page_id", "mx", "my"], "left").select(
            "page_id", "mx", "my", F.coalesce("sx", "x").alias("sx"), F.coalesce("sy", "y").alias("sy"))
    back = ends.select("page_id", "_sid", "end", "mx", "my").join(moved, ["page_id", "mx", "my"])
    side = lambda n, v: F.max(F.when(c("end") == n, c(v)))
    return (back.groupBy("page_id", "_sid").agg(side(1, "sx").alias("x1"), side(1, "sy").alias("y1"),
                                                side(2, "sx").alias("x2"), side(2, "sy").alias("y2"))
            .where((c("x1") != c("x2")) | (c("y1") != c("y2"))).drop("_sid"))


def distinct_segments(segs: DataFrame) -> DataFrame:
    """Undirected segments once each (H3)."""
    p, q = F.struct(c("x1").alias("x"), c("y1").alias("y")), F.struct(c("x2").alias("x"), c("y2").alias("y"))
    return (segs.select("page_id", F.least(p, q).alias("p"), F.greatest(p, q).alias("q")).distinct()
            .select("page_id", c("p.x").alias("x1"), c("p.y").alias("y1"), c("q.x").alias("x2"), c("q.y").alias("y2"))
            .where((c("x1") != c("x2")) | (c("y1") != c("y2"))))


# --- lines (F4, F5, D22) ---------------------------------------------------------------------------
def _on_lines(segs: DataFrame, angle_tol: float, offset_tol: float) -> DataFrame:
    """Segments with the line they lie on and their interval along it.

    Lines are buckets of angle (with the axes in bucket centres) and of distance from the page origin
    along the segment's own normal.  Segments right at a bucket edge, or not quite parallel, may fall
    apart here although a list-order grouping around a first segment would join them.
    """
    turns = 2 * int(round(math.pi / 2 / angle_tol))
    raw = F.pmod(F.atan2(c("y2") - c("y1"), c("x2") - c("x1")), F.lit(math.pi))
    half = F.when(raw > math.pi - 1e-9, 0.0).otherwise(raw)
    bucket = F.pmod(F.round(c("_half") * (turns / math.pi)).cast("bigint"), F.lit(turns))
    ux, uy = F.cos("_half"), F.sin("_half")
    t = lambda x, y: F.round(x * ux + y * uy, 9)
    p1, p2 = F.struct(c("x1").alias("x"), c("y1").alias("y")), F.struct(c("x2").alias("x"), c("y2").alias("y"))
    mid = F.round(((c("y1") + c("y2")) * ux - (c("x1") + c("x2")) * uy) / 2, 9)
    t1, t2 = t(c("x1"), c("y1")), t(c("x2"), c("y2"))
    segs = segs.withColumn("_half", half)
    return (segs.withColumn("_ak", bucket).withColumn("_ok", F.round(mid / offset_tol).cast("bigint"))
            .withColumn("lo", F.least(t1, t2)).withColumn("hi", F.greatest(t1, t2))
            .withColumn("lo_pt", F.when(t1 <= t2, p1).otherwise(p2))
            .withColumn("hi_pt", F.when(t1 <= t2, p2).otherwise(p1)))


def merge_collinear(segs: DataFrame, angle_tol: float = 0.02, offset_tol: float = SNAP) -> DataFrame:
    """Overlapping or touching segments of one line become one (F4, gaps and islands)."""
    line = Window.partitionBy("page_id", "_ak", "_ok").orderBy("lo", "hi")
    reach = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    # repeated segments go before the ordering, and ends are plain numbers, so that the last grouping needs no ordering of its own
    rows = _on_lines(segs, angle_tol, offset_tol).select(
        "page_id", "_ak", "_ok", "lo", "hi", *[c(f"{e}_pt.{v}").alias(f"{e}_{v}") for e in ("lo", "hi") for v in ("x", "y")]).distinct()
    marked = rows.withColumn("_new", (reach.isNull() | (c("lo") > reach + offset_tol)).cast("int"))
    islands = marked.withColumn("_island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda v: F.min_by(f"lo_{v}", "lo")  # noqa: E731 - of rows that start alike all take the same one
    last = lambda v: F.max_by(f"hi_{v}", "hi")
    return (islands.groupBy("page_id", "_ak", "_ok", "_island")
            .agg(first("x").alias("x1"), first("y").alias("y1"), last("x").alias("x2"), last("y").alias("y2"))
            .select("page_id", "x1", "y1", "x2", "y2"))


def gap_bridges(segs: DataFrame, max_gap: float = 45.0, tol: float = SNAP, angle_tol: float = 0.02) -> DataFrame:
    """Segments across gaps in (tol, max_gap) between neighbours of one line."""
    line = Window.partitionBy("page_id", "_ak", "_ok").orderBy("lo", "hi")
    nxt = _on_lines(segs, angle_tol, tol).withColumn("_lo2", F.lead("lo").over(line)).withColumn(
        "_p2", F.lead("lo_pt").over(line))
    gap = c("_lo2") - c("hi")
    return nxt.where((gap > tol) & (gap < max_gap)).select(
        "page_id", c("hi_pt.x").alias("x1"), c("hi_pt.y").alias("y1"), c("_p2.x").alias("x2"), c("_p2.y").alias("y2"))


def with_door_evidence(bridges: DataFrame, doors: DataFrame, radius: float = 30.0) -> DataFrame:
    """Bridges on pages with door symbols need one near their middle (D22); other pages keep all."""
    mids = bridges.withColumn("mx", (c("x1") + c("x2")) / 2).withColumn("my", (c("y1") + c("y2")) / 2)
    near = spread(doors.select("page_id", c("x").alias("dx"), c("y").alias("dy")),
                  c("dx") - radius, c("dy") - radius, c("dx") + radius, c("dy") + radius, radius)
    here = mids.withColumn("_cx", cell(c("mx"), radius)).withColumn("_cy", cell(c("my"), radius))
    cond = [here[k] == near[k] for k in ("page_id", "_cx", "_cy")] + [
        F.hypot(here["mx"] - near["dx"], here["my"] - near["dy"]) <= radius]
    proven = here.join(near, cond, "left_semi")
    free = here.join(doors.select("page_id").distinct(), "page_id", "left_anti")
    return proven.unionByName(free).select(*bridges.columns)


# --- splitting (D27, D28) ----------------------------------------------------------------------------
def split_segments(segs: DataFrame, snap: float = SNAP, crossings: bool = True) -> DataFrame:
    """Cut segments where an endpoint lies on their inside and, for axis-aligned ones, where they cross."""
    rows = _keyed(segs)
    length = F.hypot(c("x2") - c("x1"), c("y2") - c("y1"))
    sized = rows.withColumn("len", length)
    points = _ends(rows).select("page_id", c("x").alias("px"), c("y").alias("py")).distinct()
    near = spread(points, c("px") - snap, c("py") - snap, c("px") + snap, c("py") + snap, CELL)
    wide = spread(sized, F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"), CELL)
    t = ((c("px") - c("x1")) * (c("x2") - c("x1")) + (c("py") - c("y1")) * (c("y2") - c("y1"))) / c("len")
    off = F.abs((c("px") - c("x1")) * (c("y2") - c("y1")) - (c("py") - c("y1")) * (c("x2") - c("x1"))) / c("len")
    on = (wide.join(near, ["page_id", "_cx", "_cy"]).withColumn("t", t)
          .where((off <= snap) & (c("t") > snap) & (c("t") < c("len") - snap)).select("page_id", "_sid", "t").distinct())
    cuts = on
    if crossings:
        flat, upright = F.abs(c("y2") - c("y1")) < snap, F.abs(c("x2") - c("x1")) < snap
        h = sized.where(flat & ~upright).select("page_id", c("_sid").alias("h"), c("y1").alias("hy"), c("x1").alias("hs"),
                                      F.least("x1", "x2").alias("hl"), F.greatest("x1", "x2").alias("hr"))
        v = sized.where(upright & ~flat).select("page_id", c("_sid").alias("v"), c("x1").alias("vx"), c("y1").alias("vs"),
                                         F.least("y1", "y2").alias("vb"), F.greatest("y1", "y2").alias("vt"))
        hx = h.withColumn("_cx", F.explode(cells(c("hl"), c("hr"), CELL))).withColumn("_cy", cell(c("hy"), CELL))
        vx = v.withColumn("_cy", F.explode(cells(c("vb"), c("vt"), CELL))).withColumn("_cx", cell(c("vx"), CELL)).hint("merge")
        cross = hx.join(vx, ["page_id", "_cx", "_cy"]).where(
            (c("vx") > c("hl") + snap) & (c("vx") < c("hr") - snap) & (c("hy") > c("vb") + snap) & (c("hy") < c("vt") - snap))
        cuts = cuts.unionByName(cross.select("page_id", F.explode(F.array(
            F.struct(c("h").alias("_sid"), F.abs(c("vx") - c("hs")).alias("t")),
            F.struct(c("v").alias("_sid"), F.abs(c("hy") - c("vs")).alias("t")))).alias("k")).select("page_id", "k.*"))
    ends = rows.select("page_id", "_sid", F.lit(0.0).alias("t"))
    order = Window.partitionBy("page_id", "_sid").orderBy("t")
    stops = cuts.distinct().unionByName(ends)
    pieces = (stops.join(sized, ["page_id", "_sid"]).withColumn("t2", F.coalesce(F.lead("t").over(order), c("len")))
              .where(c("t2") - c("t") > snap))
    at = lambda v1, v2, s: c(v1) + (c(v2) - c(v1)) * (c(s) / c("len"))
    return pieces.select("page_id", at("x1", "x2", "t").alias("x1"), at("y1", "y2", "t").alias("y1"),
                         at("x1", "x2", "t2").alias("x2"), at("y1", "y2", "t2").alias("y2"))


# --- pruning (J5, E19) -------------------------------------------------------------------------------
def _p(n: int) -> Column:
    return F.struct("page_id", c(f"x{n}").alias("x"), c(f"y{n}").alias("y"))


def _degrees(segs: DataFrame) -> DataFrame:
    return segs.select(F.explode(F.array(_p(1), _p(2))).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("deg"))


def _with_degrees(segs: DataFrame, deg: DataFrame) -> DataFrame:
    one, two = deg.select(c("v").alias("_v1"), c("deg").alias("d1")), deg.select(c("v").alias("_v2"), c("deg").alias("d2"))
    return (segs.withColumn("_v1", _p(1)).withColumn("_v2", _p(2)).join(one, "_v1").join(two, "_v2"))


def prune_stubs(segs: DataFrame, shorter_than: float = 8.0, passes: int | None = None) -> DataFrame:
    """Peel short segments that end freely until none is left (J5); ``passes`` stops earlier.

    Only short segments can go, so the passes see those alone, with the number of long ones at each of their ends.
    """
    segs = cut(segs)
    short = F.coalesce(F.hypot(c("x2") - c("x1"), c("y2") - c("y1")) < shorter_than, F.lit(False))
    state, long = cut(segs.where(short)), segs.where(~short)
    left = state.count()
    if not left or passes == 0:
        return segs
    fixed = cut(long.select(F.explode(F.array(_p(1), _p(2))).alias("v")).join(_degrees(state).select("v"), "v", "left_semi")
                .groupBy("v").agg(F.count(F.lit(1)).alias("deg")))
    size, done = None, 0
    while left != size and (passes is None or done < passes):
        deg = _degrees(state).unionByName(fixed).groupBy("v").agg(F.sum("deg").alias("deg"))
        # a spur thins out from its end, so later passes only look at what is left
        old, state = state, cut(_with_degrees(state, deg).where((c("d1") != 1) & (c("d2") != 1)).select(*segs.columns))
        release(segs.sparkSession, old)
        size, left, done = left, state.count(), done + 1
    return long.unionByName(state)


def wall_components(segs: DataFrame) -> DataFrame:
    """Segments with their connected component and its total length."""
    comp = components(segs.select(_p(1).alias("a"), _p(2).alias("b")), "a.page_id")
    marked = segs.withColumn("node", _p(1)).join(comp, "node").drop("node")
    run = marked.groupBy("component").agg(F.sum(F.hypot(c("x2") - c("x1"), c("y2") - c("y1"))).alias("component_len"))
    return marked.join(run, "component")


def prune_components(segs: DataFrame, ratio: float = 0.04) -> DataFrame:
    """Drop networks shorter than a share of the page's longest one."""
    marked = cut(wall_components(segs))
    top = marked.groupBy("page_id").agg(F.max("component_len").alias("_top"))
    return marked.join(top, "page_id").where(c("component_len") >= c("_top") * ratio).select(*segs.columns)


def clean_walls(segs: DataFrame, snap: float = SNAP, max_gap: float = 45.0, ratio: float = 0.04,
                stub: float = 8.0) -> DataFrame:
    """The cleaned wall network as undirected edges."""
    seeds = segs.where(F.hypot(c("x2") - c("x1"), c("y2") - c("y1")) >= 1)
    merged = merge_collinear(snap_segments(seeds, snap), offset_tol=snap)
    joined = snap_segments(split_segments(merged, snap, crossings=False), snap)
    bridged = cut(joined.unionByName(gap_bridges(joined, max_gap, snap)))
    edges = distinct_segments(split_segments(merge_collinear(bridged, offset_tol=snap), snap, crossings=False))
    return prune_components(prune_stubs(edges, stub), ratio)


# --- half-edges and faces (F6, J4, C16) --------------------------------------------------------------
def half_edges(edges: DataFrame) -> DataFrame:
    """Directed edges h with the next one around the same face.

    At the far vertex the next edge is the one before the way back in counter-clockwise order.
    """
    ring = edges.withColumn("h", F.explode(F.array(
        F.struct(c("x1").alias("ox"), c("y1").alias("oy"), c("x2").alias("tx"), c("y2").alias("ty")),
        F.struct(c("x2").alias("ox"), c("y2").alias("oy"), c("x1").alias("tx"), c("y1").alias("ty"))))).select("page_id", "h")
    out = ring.withColumn("angle", F.atan2(c("h.ty") - c("h.oy"), c("h.tx") - c("h.ox")))
    around = Window.partitionBy("page_id", "h.ox", "h.oy").orderBy("angle")
    last = F.last("h").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.lag("h").over(around), last)
    twin = F.struct(c("h.tx").alias("ox"), c("h.ty").alias("oy"), c("h.ox").alias("tx"), c("h.oy").alias("ty"))
    return out.withColumn("next", before).select("page_id", twin.alias("h"), "next")


def _walk_batches(batch_rows: int, closed=None):
    """Arrow batches with id, to -> the same rows with m, d: smallest id on the row's cycle and the steps to it.

    Rows whose cycle is not whole yet wait for the next batch; too many of them, and those left at the end, have m null.
    ``closed`` may turn the rows of whole cycles, with their m and d, into other columns; rows have these null.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def finished(table, m, d):
            cols = {n: table.column(n) for n in table.column_names} | {"m": m, "d": d}
            yield from pa.table(cols).combine_chunks().to_batches()

        def unfinished(table):
            none = pa.nulls(table.num_rows, pa.int64())
            return finished(table, none, none)

        def walk(table):
            ids, to = (table.column(n).to_numpy() for n in ("id", "to"))
            n = len(ids)
            order = np.argsort(ids, kind="stable")
            at = np.minimum(np.searchsorted(ids[order], to), n - 1)
            nxt = np.append(np.where(ids[order[at]] == to, order[at], n), n)  # row n: not here
            m, d, step, lost = np.append(ids, np.iinfo(np.int64).max), np.zeros(n + 1, np.int64), 1, -1
            while True:
                ahead = m[nxt]
                moved, gone = ahead < m, int((nxt == n).sum())
                if not moved.any() and gone == lost:
                    break
                d = np.where(moved, d[nxt] + step, d)
                m, nxt, step, lost = np.minimum(m, ahead), nxt[nxt], step * 2, gone
            return m[:n], d[:n], nxt[:n] < n

        held, count = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            m, d, whole = walk(table)
            done = table.filter(pa.array(whole))
            yield from finished(done, pa.array(m[whole]), pa.array(d[whole])) if closed is None else closed(done, m[whole], d[whole])
            rest.append(table.filter(pa.array(~whole)))

        rest: list = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= batch_rows:
                yield from flush()
                table = rest.pop()
                if table.num_rows >= batch_rows // 2:
                    yield from unfinished(table)
                    table = table.slice(0, 0)
                held[:], count = table.to_batches(), table.num_rows
        if held:
            yield from flush()
            yield from unfinished(rest.pop())
    return run


def _walked(edges: DataFrame, place: str, batch_rows: int = 1 << 18) -> DataFrame:
    """``edges`` (id, to: a permutation of 64-bit ids) with m, d: smallest id of the row's cycle and steps to it.

    Cycles whose rows share their ``place`` are mostly walked within bounded batches.  The others are walked by doubling,
    which carries the smallest id among the next 1, 2, 4, ... rows until no label moves: a cycle longer than the reach
    holds a row whose label moves in the next round, so every cycle, however long, is walked to its end in about log2
    of its length rounds.
    """
    schema = StructType([*edges.schema.fields, StructField("m", LongType()), StructField("d", LongType())])
    done = cut(edges.repartition(place).sortWithinPartitions(place).mapInArrow(_walk_batches(batch_rows), schema))
    far = _doubled(done.where(c("m").isNull()))
    return done if far is None else done.where(c("m").isNotNull()).unionByName(far)


def _doubled(open_: DataFrame) -> DataFrame | None:
    """The rows that batches left open, with m and d; None if there are none."""
    spark = open_.sparkSession
    state = cut(open_.select("id", "to", c("id").alias("m"), F.lit(0).cast("long").alias("d"), F.lit(True).alias("moved")))
    if state.isEmpty():
        return None
    step = 1
    while not state.where("moved").isEmpty():
        ahead = state.select(c("id").alias("to"), c("to").alias("to2"), c("m").alias("m2"), c("d").alias("d2"))
        old, state = state, cut(state.join(ahead, "to").select(
            "id", c("to2").alias("to"), F.least("m", "m2").alias("m"),
            F.when(c("m") <= c("m2"), c("d")).otherwise(c("d2") + step).alias("d"), (c("m2") < c("m")).alias("moved")))
        step *= 2
        del ahead
        release(spark, old)
    return open_.drop("m", "d").join(state.select("id", "m", "d"), "id").select(*open_.columns)


FACE_ROW = ("struct<n:bigint,first:struct<ox:double,oy:double,tx:double,ty:double>,twice:double,x0:double,y0:double,x1:double,y1:double,"
            "polygon:array<struct<x:double,y:double>>>")


def _closed_faces(table, m, d):
    """Rows (page_id, h, id, to) of whole cycles -> one row (page_id, face) per cycle, its corners from the least half-edge on."""
    import numpy as np
    import pyarrow as pa

    count = table.num_rows
    if not count:
        return
    table = table.combine_chunks()
    h = table.column("h").combine_chunks()
    ox, oy, tx, ty = (h.field(n).to_numpy(zero_copy_only=False) for n in ("ox", "oy", "tx", "ty"))
    by = np.lexsort((ty, tx, oy, ox, m))
    starts = np.flatnonzero(np.concatenate([[True], m[by][1:] != m[by][:-1]]))
    n = np.diff(np.append(starts, count))
    face, least = np.repeat(np.arange(len(n)), n), by[starts]
    place = np.lexsort(((d[least][face] - d[by]) % n[face], face))  # along the walk, which the least half-edge starts
    walk = by[place]
    xy = pa.StructArray.from_arrays([pa.array(ox[walk]), pa.array(oy[walk])], ["x", "y"])
    ring = pa.ListArray.from_arrays(pa.array(np.append(starts, count).astype(np.int32)), xy)
    rim = lambda f, v: pa.array(f.reduceat(v[by], starts))
    row = pa.StructArray.from_arrays(
        [pa.array(n), h.take(pa.array(least)), rim(np.add, ox * ty - tx * oy), rim(np.fmin, ox), rim(np.fmin, oy),
         rim(np.fmax, ox), rim(np.fmax, oy), ring], ["n", "first", "twice", "x0", "y0", "x1", "y1", "polygon"])
    none = pa.nulls(len(n), pa.int64())
    cols = {"page_id": table.column("page_id").combine_chunks().take(pa.array(least)), "h": pa.nulls(len(n), h.type), "id": none, "to": none,
            "m": none, "d": none, "face": row}
    yield pa.record_batch(cols)


def _face_batches(batch_rows: int):
    """Arrow batches of half-edges -> a row with ``face`` per whole cycle; the half-edges of other cycles have it null."""
    def run(batches):
        import pyarrow as pa

        num, xy = pa.float64(), pa.struct([("x", pa.float64()), ("y", pa.float64())])
        kind = pa.struct([("n", pa.int64()), ("first", pa.struct([(k, num) for k in ("ox", "oy", "tx", "ty")])), ("twice", num),
                          *[(k, num) for k in ("x0", "y0", "x1", "y1")], ("polygon", pa.list_(xy))])
        for batch in _walk_batches(batch_rows, _closed_faces)(batches):
            yield batch if "face" in batch.schema.names else batch.append_column("face", pa.nulls(batch.num_rows, kind))
    return run


def faces(half: DataFrame, max_vertices: int | None = None, batch_rows: int = 1 << 18) -> DataFrame:
    """Closed face cycles: page_id, face, vertices, polygon, area (signed), box; ``max_vertices`` filters the result.

    ``next`` permutes the half-edges of a page; the walk carries 64-bit ids.  Cycles that a batch holds whole leave it as one
    row each; only the half-edges of others are written and grouped.
    """
    key = lambda h: F.xxhash64("page_id", f"{h}.ox", f"{h}.oy", f"{h}.tx", f"{h}.ty")
    edges = half.select("page_id", "h", key("h").alias("id"), key("next").alias("to"))
    schema = f"page_id {edges.schema['page_id'].dataType.simpleString()}, h {edges.schema['h'].dataType.simpleString()}, id long, `to` long, m long, d long, face {FACE_ROW}"
    # half-edges of a page lie side by side, so that a batch tears apart no more than the pages at its ends
    done = cut(edges.repartition("page_id").sortWithinPartitions("page_id").mapInArrow(_face_batches(batch_rows), schema))
    part = done.where(c("face").isNotNull()).select("page_id", "face.*")
    far = _doubled(done.where(c("face").isNull()).drop("face"))
    if far is not None:
        part = part.unionByName(_far_faces(far))
    good = part.where((c("n") >= 3) & (F.lit(True) if max_vertices is None else c("n") <= max_vertices))
    return good.select(
        "page_id", F.concat_ws(",", "first.ox", "first.oy", "first.tx", "first.ty").alias("face"),
        c("n").alias("vertices"), (c("twice") / 2).alias("area"), F.struct("x0", "y0", "x1", "y1").alias("box"), "polygon")


def _far_faces(label: DataFrame) -> DataFrame:
    """Labelled half-edges of cycles that several batches held -> one row per cycle."""
    part = label.groupBy("page_id", "m").agg(
        F.count(F.lit(1)).alias("n"), F.min("h").alias("first"), F.min_by("d", "h").alias("d0"),
        F.sum(c("h.ox") * c("h.ty") - c("h.tx") * c("h.oy")).alias("twice"),
        F.min("h.ox").alias("x0"), F.min("h.oy").alias("y0"), F.max("h.ox").alias("x1"), F.max("h.oy").alias("y1"),
        F.collect_list(F.struct("d", c("h.ox").alias("x"), c("h.oy").alias("y"))).alias("ring"))  # one polygon, as long as it is

    def away(p: Column) -> Column:  # edges from here to the first one
        k = F.pmod(p["d"] - c("d0"), c("n"))
        return F.struct(F.when(k == 0, -c("n")).otherwise(-k).alias("k"), p["x"].alias("x"), p["y"].alias("y"))

    points = F.transform(F.array_sort(F.transform("ring", away)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return part.select("page_id", "n", "first", "twice", "x0", "y0", "x1", "y1", points.alias("polygon"))


def room_faces(segs: DataFrame, pages: DataFrame, doors: DataFrame | None = None, snap: float = SNAP,
               max_gap: float = 45.0, door_radius: float = 30.0, min_area: float = 4000.0, max_area: float = 5e6,
               max_aspect: float = 25.0, max_vertices: int | None = None) -> DataFrame:
    """Rooms as faces of the wall network (J4, C16); ``pages``: page_id, page_w, page_h."""
    snapped = cut(snap_segments(segs, snap))
    axis = (F.abs(c("y2") - c("y1")) < snap) | (F.abs(c("x2") - c("x1")) < snap)
    bridges = gap_bridges(snapped.where(axis), max_gap, snap)
    if doors is not None:
        bridges = with_door_evidence(bridges, doors, door_radius)
    split = split_segments(distinct_segments(snapped.unionByName(bridges)), snap)
    edges = cut(distinct_segments(snap_segments(split, snap)))
    found = faces(half_edges(edges), max_vertices)
    w, h = c("box.x1") - c("box.x0"), c("box.y1") - c("box.y0")
    return (found.join(pages, "page_id").where(
        (c("area") > 0) & (c("area") < 0.85 * c("page_w") * c("page_h")) & c("area").between(min_area, max_area)
        & (w >= 1) & (h >= 1) & (F.greatest(w / h, h / w) <= max_aspect)).drop("page_w", "page_h"))


# --- runs and strays (J6, J7) --------------------------------------------------------------------------
def wall_runs(edges: DataFrame) -> DataFrame:
    """Edges with the run they belong to; runs pass through vertices where exactly two edges meet."""
    tagged = cut(edges.withColumn("eid", F.struct("page_id", "x1", "y1", "x2", "y2")))
    at = tagged.select("eid", F.explode(F.array(_p(1), _p(2))).alias("v"))
    two = at.groupBy("v").agg(F.count(F.lit(1)).alias("deg"), F.min("eid").alias("a"), F.max("eid").alias("b"))
    comp = components(two.where((c("deg") == 2) & (c("a") != c("b"))).select("a", "b"), "a.page_id")
    ends = at.join(two.where(c("deg") != 2).select("v"), "v").groupBy("eid").agg(F.count(F.lit(1)).alias("free"))
    return (tagged.join(comp.withColumnRenamed("node", "eid"), "eid", "left").join(ends, "eid", "left")
            .select(*edges.columns, F.coalesce("component", "eid").alias("run"), F.coalesce("free", F.lit(0)).alias("free")))


def run_summary(runs: DataFrame) -> DataFrame:
    """Length and number of edges per run; a run without a free or branching end is closed."""
    return runs.groupBy("page_id", "run").agg(
        F.count(F.lit(1)).alias("edges"), F.sum(F.hypot(c("x2") - c("x1"), c("y2") - c("y1"))).alias("length_pt"),
        (F.sum("free") == 0).alias("closed"), F.min(F.struct("x1", "y1")).alias("first"))


def filter_stray(edges: DataFrame, margin: float = 0.06, min_component: float = 0.1, min_region: float = 0.6) -> DataFrame:
    """Runs flagged ``kept`` when their network is long enough and they lie mostly in the plan's region."""
    runs = wall_runs(edges)
    comp = cut(wall_components(edges))
    top = comp.groupBy("page_id").agg(F.max("component_len").alias("top"),
                                      F.max_by("component", F.struct("component_len", "component")).alias("main"))
    ends = comp.join(top, "page_id").where(c("component") == c("main"))
    box = ends.groupBy("page_id", "top").agg(
        F.min(F.least("x1", "x2")).alias("bx0"), F.min(F.least("y1", "y2")).alias("by0"),
        F.max(F.greatest("x1", "x2")).alias("bx1"), F.max(F.greatest("y1", "y2")).alias("by1"))
    slack = F.greatest(c("bx1") - c("bx0"), c("by1") - c("by0")) * margin
    pts = runs.join(comp.select("page_id", "x1", "y1", "x2", "y2", "component_len"), ["page_id", "x1", "y1", "x2", "y2"]).select(
        "page_id", "run", "component_len", F.explode(F.array(_p(1), _p(2))).alias("v")).distinct()
    inside = (c("v.x").between(c("bx0") - slack, c("bx1") + slack) & c("v.y").between(c("by0") - slack, c("by1") + slack))
    return (pts.join(box, "page_id").groupBy("page_id", "run").agg(
        F.avg(inside.cast("double")).alias("share"), F.max(c("component_len") / c("top")).alias("relative"))
        .withColumn("kept", (c("relative") >= min_component) & (c("share") >= min_region)))


def trace_confidence(runs: DataFrame) -> DataFrame:
    """Confidence from a run's length relative to the page's longest."""
    top = runs.groupBy("page_id").agg(F.max("length_pt").alias("_top"))
    score = F.greatest(F.lit(0.55), F.least(F.lit(0.95), F.lit(0.55) + c("length_pt") / c("_top") * 0.4))
    return runs.join(top, "page_id").withColumn("confidence", F.when(c("_top") > 0, score).otherwise(0.6)).drop("_top")


def run_points(runs: DataFrame) -> DataFrame:
    """Vertices of every run in walking order: page_id, run, pos, x, y.

    Each edge is taken in both directions and points back to the edge before it through a vertex
    where exactly two edges meet.  Doubling those pointers gives each directed edge its distance from
    the start; of the two directions the one with the smaller first edge is kept.  A closed run starts
    (and ends) at its smallest corner, which counts as an end here.  The rounds carry 64-bit ids of
    directed edges; only the edges of the direction that is kept meet their coordinates again.
    """
    spark = runs.sparkSession
    runs = cut(runs)  # read by several steps; what callers give is a join itself
    way = lambda a, b: F.struct(c(f"x{a}").alias("ox"), c(f"y{a}").alias("oy"), c(f"x{b}").alias("tx"), c(f"y{b}").alias("ty"))
    key = lambda o, t: F.xxhash64("page_id", "run", f"h.{o}x", f"h.{o}y", f"h.{t}x", f"h.{t}y")
    half = runs.select("page_id", "run", F.explode(F.array(way(1, 2), way(2, 1))).alias("h")).withColumn("id", key("o", "t"))
    point = lambda n: F.struct(c(f"x{n}").alias("x"), c(f"y{n}").alias("y"))
    corner = runs.groupBy("page_id", "run").agg(F.sum("free").alias("free"), F.min(F.least(point(1), point(2))).alias("v")).where(
        c("free") == 0).select("page_id", "v.x", "v.y").distinct()
    # of the two ways out of a vertex each follows the other one's way in
    out = half.select("page_id", c("h.ox").alias("x"), c("h.oy").alias("y"), "id", key("t", "o").alias("back"),
                      F.xxhash64("run").alias("run"), F.xxhash64("h.tx", "h.ty").alias("to"))
    two = out.groupBy("page_id", "x", "y").agg(
        F.count(F.lit(1)).alias("deg"), F.min("id").alias("a"), F.max("id").alias("b"), F.min_by("back", "id").alias("into_a"),
        F.max_by("back", "id").alias("into_b"), *[f(n).alias(f"{k}_{n}") for n in ("run", "to") for k, f in (("lo", F.min), ("hi", F.max))])
    through = two.where((c("deg") == 2) & (c("lo_run") == c("hi_run")) & (c("lo_to") != c("hi_to"))).join(corner, ["page_id", "x", "y"], "left_anti")
    state = cut(through.select(F.inline(F.array(
        F.struct(c("a").alias("id"), c("into_b").alias("prev"), F.lit(1).alias("pos"), c("into_b").alias("start")),
        F.struct(c("b").alias("id"), c("into_a").alias("prev"), F.lit(1).alias("pos"), c("into_a").alias("start"))))))
    while not state.where(c("prev").isNotNull()).isEmpty():
        back = state.select(c("id").alias("prev"), c("prev").alias("p2"), c("pos").alias("n2"), c("start").alias("s2"))
        on = state.where(c("prev").isNotNull()).join(back, "prev", "left").select(
            "id", c("p2").alias("prev"), (c("pos") + F.coalesce("n2", F.lit(0))).alias("pos"), F.coalesce("s2", "start").alias("start"))
        old, state = state, cut(on.unionByName(state.where(c("prev").isNull())))
        del back, on
        release(spark, old)
    first = cut(half.join(state.select("id"), "id", "left_anti").groupBy("page_id", "run").agg(F.min_by("id", "h").alias("id")).select("id"))
    kept = state.join(first.select(c("id").alias("start")), "start", "left_semi").select("id", "pos").unionByName(
        first.select("id", F.lit(0).alias("pos")))
    spot = lambda n, e: F.struct((c("pos") + n).alias("pos"), c(f"h.{e}x").alias("x"), c(f"h.{e}y").alias("y"))
    ends = F.array(F.when(c("pos") == 0, spot(0, "o")), spot(1, "t"))
    return half.join(kept, "id").select("page_id", "run", F.inline(F.filter(ends, lambda e: e.isNotNull())))
