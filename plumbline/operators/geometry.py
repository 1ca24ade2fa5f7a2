"""Spatial joins between labels, faces, callouts, walls and boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import geometry as G
from plumbline.operators.graph import CELL, cell, cells, components, spread
from plumbline.session import cut

c = F.col


# --- labels in faces (D17, D18, F10) ---------------------------------------------------------------
def _face_cells(faces: DataFrame, slack: float = 0.0, size: float = 100.0) -> DataFrame:
    f = faces.select("page_id", "face", c("area").alias("face_area"), "box", "polygon")
    return spread(f, c("box.x0") - slack, c("box.y0") - slack, c("box.x1") + slack, c("box.y1") + slack, size)


def enclosing_face(points: DataFrame, faces: DataFrame, size: float = 100.0) -> DataFrame:
    """Smallest face around each point (D17); ``points``: page_id, point_id, x, y."""
    at = points.withColumn("_cx", cell(c("x"), size)).withColumn("_cy", cell(c("y"), size))
    return (at.join(_face_cells(faces, 0.0, size), ["page_id", "_cx", "_cy"])
            .where(G.in_box(c("x"), c("y"), c("box")) & G.contains_point(c("polygon"), c("x"), c("y")))
            .groupBy("page_id", "point_id").agg(F.min_by("face", F.struct("face_area", "face")).alias("face"),
                                                F.min("face_area").alias("face_area")))


def serial_pick(choices: DataFrame) -> DataFrame:
    """Each asker, in order, takes its best free item: ``choices`` = grp, ord, item, rank (smaller is better).

    Rounds of proposals: everyone asks for the best item not refused yet, an item keeps its earliest
    asker.  With one common order on the item side this ends in the one-by-one outcome.
    """
    left = cut(choices)
    while True:
        best = left.groupBy("grp", "ord").agg(F.min_by("item", F.struct("rank", "item")).alias("item"))
        kept = best.groupBy("grp", "item").agg(F.min("ord").alias("_first"))
        lost = cut(best.join(kept, ["grp", "item"]).where(c("ord") != c("_first")).select("grp", "ord", "item"))
        if lost.isEmpty():
            return best
        left = cut(left.join(lost, ["grp", "ord", "item"], "left_anti"))


def label_faces(labels: DataFrame, faces: DataFrame, radius: Column, size: float = 100.0) -> DataFrame:
    """Face of each label cluster; a face serves one label.

    ``labels``: page_id, ord, cx, cy, x0, y0, x1, y1.  Preference: smallest face around the centre,
    then around a corner, then the nearest box centre within ``radius`` (which may differ by page).
    """
    corners = F.array(*[F.struct(F.lit(p).alias("pass"), x.alias("px"), y.alias("py")) for p, x, y in (
        (1, c("cx"), c("cy")), (2, c("x0"), c("y0")), (2, c("x1"), c("y0")), (2, c("x0"), c("y1")), (2, c("x1"), c("y1")))])
    probes = labels.select("page_id", "ord", F.inline(corners)).withColumn(
        "_cx", cell(c("px"), size)).withColumn("_cy", cell(c("py"), size))
    inside = (probes.join(_face_cells(faces, 0.0, size), ["page_id", "_cx", "_cy"])
              .where(G.in_box(c("px"), c("py"), c("box")) & G.contains_point(c("polygon"), c("px"), c("py")))
              .select("page_id", "ord", "face", F.struct(c("pass").cast("double").alias("p"), c("face_area").alias("v")).alias("rank")))
    mid = faces.select("page_id", "face", ((c("box.x0") + c("box.x1")) / 2).alias("fx"), ((c("box.y0") + c("box.y1")) / 2).alias("fy"))
    middles = mid.withColumn("_cx", cell(c("fx"), size)).withColumn("_cy", cell(c("fy"), size))
    here = labels.withColumn("_r", radius).select("page_id", "ord", "cx", "cy", "_r")
    around = spread(here, c("cx") - c("_r"), c("cy") - c("_r"), c("cx") + c("_r"), c("cy") + c("_r"), size)
    dist = F.hypot(c("fx") - c("cx"), c("fy") - c("cy"))
    near = around.join(middles, ["page_id", "_cx", "_cy"]).where(dist <= c("_r")).select(
        "page_id", "ord", "face", F.struct(F.lit(3.0).alias("p"), dist.alias("v")).alias("rank"))
    ranked = inside.unionByName(near).groupBy("page_id", "ord", "face").agg(F.min("rank").alias("rank"))
    return serial_pick(ranked.select(c("page_id").alias("grp"), "ord", c("face").alias("item"), "rank")).select(
        c("grp").alias("page_id"), "ord", c("item").alias("face"))


def shared_faces(assigned: DataFrame) -> DataFrame:
    """Labels whose face an earlier label already uses."""
    first = assigned.groupBy("page_id", "face").agg(F.min("ord").alias("_first"))
    return assigned.join(first, ["page_id", "face"]).withColumn("shared", c("ord") > c("_first")).drop("_first")


# --- callouts near rooms (D19, G6) -------------------------------------------------------------------
def room_callouts(rooms: DataFrame, callouts: DataFrame, slack: float = 30.0, size: float = 100.0) -> DataFrame:
    """Callouts in a room's box plus slack with their distance from its centre."""
    wide = spread(rooms.select("page_id", "room_id", "box"), c("box.x0") - slack, c("box.y0") - slack,
                  c("box.x1") + slack, c("box.y1") + slack, size)
    at = callouts.withColumn("_cx", cell(c("x"), size)).withColumn("_cy", cell(c("y"), size))
    dx, dy = c("x") - (c("box.x0") + c("box.x1")) / 2, c("y") - (c("box.y0") + c("box.y1")) / 2
    return (wide.join(at, ["page_id", "_cx", "_cy"]).where(G.in_box(c("x"), c("y"), c("box"), slack))
            .withColumn("dist2", dx * dx + dy * dy).drop("_cx", "_cy"))


def nearest_callouts(pairs: DataFrame, n: int = 12) -> DataFrame:
    """The n nearest callouts of every room; each partition keeps only its own n before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("page_id", "room_id").orderBy("dist2", "seq"))
    return pairs.withColumn("rank", rank).where(c("rank") <= n)


def room_dimensions(rooms: DataFrame, pairs: DataFrame, tol: float = 0.25) -> DataFrame:
    """Width and height from the largest callout per axis within 25 % of the drawn size.

    ``rooms``: page_id, room_id, box, pt_per_foot.
    """
    sized = rooms.withColumn("bw", (c("box.x1") - c("box.x0")) / c("pt_per_foot")).withColumn(
        "bh", (c("box.y1") - c("box.y0")) / c("pt_per_foot"))
    near = pairs.select("page_id", "room_id", "length_ft", "orientation").join(
        sized.select("page_id", "room_id", "bw", "bh"), ["page_id", "room_id"])
    fits = lambda side: F.abs(c("length_ft") - c(side)) / F.greatest(F.lit(1.0), c(side)) <= tol
    best = near.groupBy("page_id", "room_id").agg(
        F.max(F.when((c("orientation") == "h") & fits("bw"), c("length_ft"))).alias("w"),
        F.max(F.when((c("orientation") == "v") & fits("bh"), c("length_ft"))).alias("h"),
        F.count("orientation").alias("callouts"))
    out = sized.join(best, ["page_id", "room_id"], "left")
    used = c("w").isNotNull().cast("int") + c("h").isNotNull().cast("int")
    return (out.withColumn("source", F.when(used == 2, "callouts").when(used == 0, "bbox").otherwise("mixed"))
            .withColumn("width_ft", F.coalesce("w", "bw")).withColumn("height_ft", F.coalesce("h", "bh"))
            .withColumn("area_sqft", c("width_ft") * c("height_ft"))
            .withColumn("callouts", F.coalesce("callouts", F.lit(0))).drop("w", "h", "bw", "bh"))


# --- snapping points to walls (D23) --------------------------------------------------------------------
def snap_points(points: DataFrame, segs: DataFrame, end_radius: float, edge_radius: float, size: float = CELL) -> DataFrame:
    """Nearest endpoint strictly within its radius, else nearest inner edge point.

    ``points``: page_id, point_id, x, y; ``segs``: page_id, seg_id, x1, y1, x2, y2.
    """
    r = max(end_radius, edge_radius)
    wide = spread(segs.select("page_id", "seg_id", "x1", "y1", "x2", "y2"), F.least("x1", "x2") - r, F.least("y1", "y2") - r,
                  F.greatest("x1", "x2") + r, F.greatest("y1", "y2") + r, size)
    at = points.withColumn("_cx", cell(c("x"), size)).withColumn("_cy", cell(c("y"), size))
    len2 = (c("x2") - c("x1")) * (c("x2") - c("x1")) + (c("y2") - c("y1")) * (c("y2") - c("y1"))
    pairs = at.join(wide, ["page_id", "_cx", "_cy"]).withColumn("t", F.when(len2 > 1e-12, (
        (c("x") - c("x1")) * (c("x2") - c("x1")) + (c("y") - c("y1")) * (c("y2") - c("y1"))) / len2))
    option = lambda kind, order, px, py: F.struct(
        F.lit(kind).alias("snap"), F.lit(order).alias("o"), px.alias("sx"), py.alias("sy"), F.hypot(px - c("x"), py - c("y")).alias("dist"))
    inner = F.when((c("t") > 0) & (c("t") < 1), option("edge", 1, c("x1") + (c("x2") - c("x1")) * c("t"), c("y1") + (c("y2") - c("y1")) * c("t")))
    offers = pairs.select("page_id", "point_id", "seg_id", F.explode(F.array(
        option("endpoint", 0, c("x1"), c("y1")), option("endpoint", 0, c("x2"), c("y2")), inner)).alias("s"))
    good = offers.where(((c("s.snap") == "endpoint") & (c("s.dist") < end_radius)) | ((c("s.snap") == "edge") & (c("s.dist") < edge_radius)))
    return (good.groupBy("page_id", "point_id").agg(F.min_by(F.struct("seg_id", "s"), F.struct("s.o", "s.dist", "seg_id")).alias("b"))
            .select("page_id", "point_id", "b.seg_id", "b.s.snap", "b.s.sx", "b.s.sy"))


# --- wall pairs (D24, D25) --------------------------------------------------------------------------------
def _axis(segs: DataFrame, tol: float = 1.5) -> DataFrame:
    """Axis-aligned segments as (axis, offset, lo, hi)."""
    dx, dy = F.abs(c("x2") - c("x1")), F.abs(c("y2") - c("y1"))
    axis = F.when((dy <= tol) & (dx > tol), "h").when((dx <= tol) & (dy > tol), "v")
    return (segs.withColumn("axis", axis).where(c("axis").isNotNull())
            .withColumn("off", F.when(c("axis") == "h", (c("y1") + c("y2")) / 2).otherwise((c("x1") + c("x2")) / 2))
            .withColumn("lo", F.when(c("axis") == "h", F.least("x1", "x2")).otherwise(F.least("y1", "y2")))
            .withColumn("hi", F.when(c("axis") == "h", F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2"))))


def _parallel(lines: DataFrame, near: float, far: float, overlap: float) -> DataFrame:
    """Pairs a < b by offset on one page and axis, near..far apart, sharing at least ``overlap``.

    Candidates meet in cells of offset band and running length; a pair is kept only in the first
    cell of its shared stretch.
    """
    base = lines.select("page_id", "axis", "seg_id", "off", "lo", "hi")
    banded = base.withColumn("_b", cell(c("off"), far)).withColumn("_l", F.explode(cells(c("lo"), c("hi"), CELL)))
    other = base.select("page_id", "axis", c("seg_id").alias("seg2"), c("off").alias("off2"), c("lo").alias("lo2"), c("hi").alias("hi2"))
    other = other.withColumn("_b", F.explode(F.array(cell(c("off2"), far), cell(c("off2"), far) - 1))).withColumn(
        "_l", F.explode(cells(c("lo2"), c("hi2"), CELL))).hint("merge")
    gap = c("off2") - c("off")
    lo, hi = F.greatest("lo", "lo2"), F.least("hi", "hi2")
    return (banded.join(other, ["page_id", "axis", "_b", "_l"])
            .where((gap >= near) & (gap <= far) & (hi - lo >= overlap) & (c("_l") == cell(lo, CELL)))
            .withColumn("l", lo).withColumn("h", hi))


def centerlines(segs: DataFrame, near: float = 2.5, far: float = 12.0, overlap: float = 16.0, extend: float = 7.0,
                angle_tol: float = 0.08) -> DataFrame:
    """One line per pair of parallel wall faces, axis-aligned and diagonal."""
    pairs = _parallel(_axis(segs), near, far, overlap)
    mid, lo, hi, flat = (c("off") + c("off2")) / 2, c("l") - extend, c("h") + extend, c("axis") == "h"
    straight = pairs.select("page_id", F.when(flat, lo).otherwise(mid).alias("x1"), F.when(flat, mid).otherwise(lo).alias("y1"),
                            F.when(flat, hi).otherwise(mid).alias("x2"), F.when(flat, mid).otherwise(hi).alias("y2"))
    diag = segs.where((F.abs(c("x2") - c("x1")) > 1.5) & (F.abs(c("y2") - c("y1")) > 1.5)).select("page_id", "seg_id", "x1", "y1", "x2", "y2")
    a = spread(diag, F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"), CELL)
    r = far + overlap
    b = spread(diag.select("page_id", c("seg_id").alias("seg2"), *[c(n).alias("b" + n) for n in ("x1", "y1", "x2", "y2")]),
               F.least("bx1", "bx2") - r, F.least("by1", "by2") - r, F.greatest("bx1", "bx2") + r, F.greatest("by1", "by2") + r, CELL)
    near_pairs = a.join(b, ["page_id", "_cx", "_cy"]).where(c("seg_id") < c("seg2")).drop("_cx", "_cy").distinct()
    la, lb = F.hypot(c("x2") - c("x1"), c("y2") - c("y1")), F.hypot(c("bx2") - c("bx1"), c("by2") - c("by1"))
    ux, uy = (c("x2") - c("x1")) / c("la"), (c("y2") - c("y1")) / c("la")
    cross = F.abs(ux * (c("by2") - c("by1")) - uy * (c("bx2") - c("bx1"))) / lb
    side = (c("by1") - c("y1")) * ux - (c("bx1") - c("x1")) * uy
    at = lambda x, y: (c(x) - c("x1")) * ux + (c(y) - c("y1")) * uy
    m = (near_pairs.withColumn("la", la).withColumn("side", side).withColumn("p", at("bx1", "by1")).withColumn("q", at("bx2", "by2"))
         .where((cross <= math.sin(angle_tol)) & F.abs(c("side")).between(near, far))
         .withColumn("lo", F.greatest(F.lit(0.0), F.least("p", "q")) - extend).withColumn("hi", F.least(c("la"), F.greatest("p", "q")) + extend)
         .where(c("hi") - c("lo") >= overlap))
    ox, oy = -uy * c("side") / 2, ux * c("side") / 2
    slanted = m.select("page_id", (c("x1") + ux * c("lo") + ox).alias("x1"), (c("y1") + uy * c("lo") + oy).alias("y1"),
                       (c("x1") + ux * c("hi") + ox).alias("x2"), (c("y1") + uy * c("hi") + oy).alias("y2"))
    return straight.unionByName(slanted)


def drop_stacks(lines: DataFrame, near: float = 3.0, far: float = 16.0, overlap: float = 16.0) -> DataFrame:
    """Drop lines with two or more parallel neighbours close by: ladders of dimension lines."""
    pairs = _parallel(_axis(lines), near, far, overlap)
    busy = (pairs.select("page_id", F.explode(F.array("seg_id", "seg2")).alias("seg_id")).groupBy("page_id", "seg_id")
            .agg(F.count(F.lit(1)).alias("n")).where(c("n") >= 2))
    return lines.join(busy, ["page_id", "seg_id"], "left_anti")


# --- rooms from rays (D26) ---------------------------------------------------------------------------------
def ray_rooms(labels: DataFrame, segs: DataFrame, min_side: float, max_side: float, min_wall: float, clearance: float,
              size: float = 100.0, keep: list[str] = ()) -> DataFrame:
    """Nearest long wall on each side of a label's box, as a rectangle.

    ``labels``: page_id, label_id, x0, y0, x1, y1, page_w, page_h; at least two sides must be hit.  ``keep`` names columns
    of the labels to hand on.
    """
    at = labels.withColumn("cx", (c("x0") + c("x1")) / 2).withColumn("cy", (c("y0") + c("y1")) / 2)
    long = segs.where(F.abs(c("x2") - c("x1")) + F.abs(c("y2") - c("y1")) >= min_wall)
    h = long.where(c("y1") == c("y2")).select("page_id", F.least("x1", "x2").alias("a"), F.greatest("x1", "x2").alias("b"), c("y1").alias("v"))
    w = long.where(c("x1") == c("x2")).select("page_id", F.least("y1", "y2").alias("a"), F.greatest("y1", "y2").alias("b"), c("x1").alias("v"))

    def side(walls: DataFrame, along: str, lo: str, hi: str, names: tuple[str, str], limit: Column) -> DataFrame:
        bucket = walls.withColumn("_k", F.explode(cells(c("a"), c("b"), size))).hint("merge")
        hit = at.withColumn("_k", cell(c(along), size)).join(bucket, ["page_id", "_k"]).where(c(along).between(c("a"), c("b")))
        above, below = c("v") > c(hi) + clearance, c("v") < c(lo) - clearance
        return hit.groupBy("page_id", "label_id").agg(
            F.min(F.when(above & (c("v") < limit), c("v"))).alias(names[1]),
            F.max(F.when(below & (c("v") > 0), c("v"))).alias(names[0]))

    box = (at.join(side(h, "cx", "y0", "y1", ("bottom", "top"), c("page_h")), ["page_id", "label_id"], "left")
           .join(side(w, "cy", "x0", "x1", ("left", "right"), c("page_w")), ["page_id", "label_id"], "left"))
    hits = sum((c(n).isNotNull().cast("int") for n in ("top", "bottom", "left", "right")), F.lit(0))
    zero = F.lit(0.0)
    out = box.withColumn("hits", hits).withColumn("box", F.struct(
        F.coalesce("left", zero).alias("x0"), F.coalesce("bottom", zero).alias("y0"),
        F.coalesce("right", "page_w").alias("x1"), F.coalesce("top", "page_h").alias("y1")))
    width, height = c("box.x1") - c("box.x0"), c("box.y1") - c("box.y0")
    return out.where((c("hits") >= 2) & width.between(min_side, max_side) & height.between(min_side, max_side)).select(
        "page_id", "label_id", "box", *keep)


# --- rectangles (D29) ----------------------------------------------------------------------------------------
def rectangles(segs: DataFrame, tol: float = 1.5, min_side: float = 20.0, min_area: float = 5000.0, max_area: float = 5e6) -> DataFrame:
    """Rectangles closed by two horizontal and two vertical walls; those inside a larger one go."""
    lines = _axis(segs, tol)
    h = lines.where(c("axis") == "h").select("page_id", (F.floor(c("off") / tol + 0.5) * tol).alias("y"), "lo", "hi").distinct()
    v = lines.where(c("axis") == "v").select("page_id", c("off").alias("x"), c("lo").alias("vl"), c("hi").alias("vh")).distinct()
    # a crossing lies in the one cell of the upright's x and the level's y: every pair meets once, so none repeats
    hx = h.withColumn("_cx", F.explode(cells(c("lo") - 2 * tol, c("hi") + 2 * tol, 2 * CELL))).withColumn("_cy", cell(c("y"), 2 * CELL))
    vx = v.withColumn("_cy", F.explode(cells(c("vl") - tol, c("vh") + tol, 2 * CELL))).withColumn("_cx", cell(c("x"), 2 * CELL)).hint("merge")
    touch = hx.join(vx, ["page_id", "_cx", "_cy"]).where(
        c("x").between(c("lo") - 2 * tol, c("hi") + 2 * tol) & c("y").between(c("vl") - tol, c("vh") + tol)).select(
        "page_id", "x", "vl", "vh", "y", "lo", "hi")
    # both sides have the same columns, so that one shuffle serves both
    same = [c(f"s.{n}") == c(f"t.{n}") for n in ("page_id", "x", "vl", "vh")]
    pairs = touch.alias("s").join(touch.alias("t"), same).where(c("t.y") - c("s.y") >= min_side).select(
        "s.page_id", "s.x", "s.y", "s.lo", "s.hi", c("t.y").alias("y2"), c("t.lo").alias("lo2"), c("t.hi").alias("hi2"))
    left, right = F.greatest("lo", "lo2"), F.least("hi", "hi2")
    key = ["page_id", "y", "lo", "hi", "y2", "lo2", "hi2"]
    ends = pairs.select(*key, (F.abs(c("x") - left) <= 1.5 * tol).alias("_a"), (F.abs(c("x") - right) <= 1.5 * tol).alias("_b"))
    both = ends.where(c("_a") | c("_b")).groupBy(*key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).where(c("_a") & c("_b"))
    w, ht = right - left, c("y2") - c("y")
    found = both.where((w >= min_side) & (w * ht).between(min_area, max_area)).select(
        "page_id", F.struct(left.alias("x0"), c("y").alias("y0"), right.alias("x1"), c("y2").alias("y1")).alias("box"), (w * ht).alias("area"))
    grid = F.struct(*[F.floor(c(f"box.{n}") + 0.5).alias(n) for n in ("x0", "y0", "x1", "y1")])
    unique = cut(found.groupBy("page_id", grid.alias("_g")).agg(F.max_by("box", "area").alias("box"), F.max("area").alias("area")).drop("_g"))
    outer = spread(unique.select("page_id", c("box").alias("ob"), c("area").alias("oa")), c("ob.x0") - tol, c("ob.y0") - tol,
                   c("ob.x1") + tol, c("ob.y1") + tol, 200.0)
    inner = unique.withColumn("_cx", cell(c("box.x0"), 200.0)).withColumn("_cy", cell(c("box.y0"), 200.0))
    cond = [inner[k] == outer[k] for k in ("page_id", "_cx", "_cy")] + [
        c("oa") > c("area"), c("box.x0") >= c("ob.x0") - tol, c("box.y0") >= c("ob.y0") - tol, c("box.x1") <= c("ob.x1") + tol,
        c("box.y1") <= c("ob.y1") + tol]
    return inner.join(outer, cond, "left_anti").select("page_id", "box", "area")


# --- first come, first kept (D30, F9) ----------------------------------------------------------------------------
def first_come(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Nodes (grp, ord) accepted in order when no earlier *accepted* one conflicts; ``conflicts``: grp, earlier, later.

    Each round accepts what has no open earlier rival and refuses what an accepted one blocks.
    """
    open_, rivals, kept = cut(nodes.select("grp", "ord")), cut(conflicts.select("grp", "earlier", "later").distinct()), None
    while True:
        waiting = rivals.select("grp", c("later").alias("ord")).distinct()
        fine = cut(open_.join(waiting, ["grp", "ord"], "left_anti"))
        kept = fine if kept is None else cut(kept.unionByName(fine))
        refused = rivals.join(fine.withColumnRenamed("ord", "earlier"), ["grp", "earlier"]).select("grp", c("later").alias("ord")).distinct()
        open_ = cut(open_.join(fine, ["grp", "ord"], "left_anti").join(refused, ["grp", "ord"], "left_anti"))
        if open_.isEmpty():
            return kept
        live = open_.withColumnRenamed("ord", "later")
        rivals = cut(rivals.join(live, ["grp", "later"]).join(open_.withColumnRenamed("ord", "earlier"), ["grp", "earlier"]).select(
            "grp", "earlier", "later"))


def drop_overlaps(boxes: DataFrame, limit: float = 0.5, size: float = 200.0) -> DataFrame:
    """Boxes in order, without those that overlap an accepted one by more than ``limit`` IoU."""
    rows = boxes.select(c("page_id").alias("grp"), "ord", "box")
    a = spread(rows, c("box.x0"), c("box.y0"), c("box.x1"), c("box.y1"), size)
    b = a.select("grp", "_cx", "_cy", c("ord").alias("later"), c("box").alias("box2"))
    pairs = a.join(b, ["grp", "_cx", "_cy"]).where((c("ord") < c("later")) & (G.iou(c("box"), c("box2")) > limit))
    kept = first_come(rows, pairs.select("grp", c("ord").alias("earlier"), "later"))
    return boxes.join(kept.withColumnRenamed("grp", "page_id"), ["page_id", "ord"], "left_semi")


def drop_near_duplicates(labels: DataFrame, radius: float = 0.06) -> DataFrame:
    """Labels in order, without those within ``radius`` of a kept one of the same folded text.

    ``labels``: page_id, ord, key, x, y.
    """
    rows = labels.select(c("page_id").alias("grp"), "ord", "key", "x", "y")
    a = rows.withColumn("_cx", cell(c("x"), radius)).withColumn("_cy", cell(c("y"), radius))
    b = spread(rows.select("grp", "key", c("ord").alias("later"), c("x").alias("x2"), c("y").alias("y2")),
               c("x2") - radius, c("y2") - radius, c("x2") + radius, c("y2") + radius, radius)
    pairs = a.join(b, ["grp", "key", "_cx", "_cy"]).where((c("ord") < c("later")) & (F.hypot(c("x") - c("x2"), c("y") - c("y2")) < radius))
    kept = first_come(rows, pairs.select("grp", c("ord").alias("earlier"), "later"))
    return labels.join(kept.withColumnRenamed("grp", "page_id"), ["page_id", "ord"], "left_semi")


# --- label clusters and columns (E23, F7, G5) ------------------------------------------------------------------
def label_clusters(labels: DataFrame, distance: float = 25.0, in_list_order: bool = False) -> DataFrame:
    """Label fragments within 25 pt joined into one label.

    The text reads top to bottom and left to right with fragment centres averaged, or keeps list
    order with fragment positions averaged.
    """
    order = "seq" if in_list_order else "y DESC, x"
    half = 0.0 if in_list_order else 0.5
    node = F.struct("page_id", "seq")
    a = labels.withColumn("_cx", cell(c("x"), distance)).withColumn("_cy", cell(c("y"), distance))
    b = spread(labels.select("page_id", c("seq").alias("seq2"), c("x").alias("x2"), c("y").alias("y2")), c("x2") - distance,
               c("y2") - distance, c("x2") + distance, c("y2") + distance, distance)
    pairs = a.join(b, ["page_id", "_cx", "_cy"]).where((c("seq") < c("seq2")) & (F.hypot(c("x") - c("x2"), c("y") - c("y2")) <= distance))
    comp = components(pairs.select(node.alias("a"), F.struct("page_id", c("seq2").alias("seq")).alias("b")), "a.page_id")
    marked = labels.withColumn("node", node).join(comp, "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    return marked.groupBy("page_id", c("cluster.seq").alias("label_id")).agg(
        F.expr(f"listagg(trim(text), ' ') WITHIN GROUP (ORDER BY {order})").alias("text"),
        F.avg(c("x") + c("width") * half).alias("cx"), F.avg(c("y") + c("height") * half).alias("cy"), F.min("x").alias("x0"),
        F.min("y").alias("y0"), F.max(c("x") + c("width")).alias("x1"), F.max(c("y") + c("height")).alias("y1"))


def densest_column(labels: DataFrame, half: float = 0.05) -> DataFrame:
    """Largest share of a page's labels within ``half`` of one of them, by x (F7): side panel or drop-out column.

    Positions are counted per distinct value first, so the ordering sees few rows per page.
    """
    spots = labels.groupBy("page_id", "x").agg(F.count(F.lit(1)).alias("n"))
    near = F.expr(f"sum(n) OVER (PARTITION BY page_id ORDER BY x RANGE BETWEEN {half}D PRECEDING AND {half}D FOLLOWING)")
    out = spots.withColumn("near", near).groupBy("page_id").agg(F.max("near").alias("most"), F.sum("n").alias("labels"))
    share = c("most") / c("labels")
    return out.select("page_id", share.alias("share"), ((c("labels") >= 3) & (share >= 0.8)).alias("side_panel"),
                      ((c("labels") >= 6) & (share >= 0.5)).alias("drop_cluster"))


def largest_labels(labels: DataFrame, n: int = 30) -> DataFrame:
    """The n labels with the largest type per page."""
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("font_size"), "seq"))
    return labels.withColumn("rank", rank).where(c("rank") <= n)


# --- regions (D32) ---------------------------------------------------------------------------------------------
def best_region(lines: DataFrame, regions: DataFrame, margin: float) -> DataFrame:
    """Polylines inside the region that holds most line length; pages without a hit keep all.

    ``lines``: page_id, line_id, mx, my (mean vertex, normalised), length_pt; ``regions``: page_id, ord, box.
    The first of equally good regions counts.  Regions are the few boxes drawn on one sheet.
    """
    hits = lines.join(regions, "page_id").where(G.in_box(c("mx"), c("my"), c("box"), margin))
    best = (hits.groupBy("page_id", "ord").agg(F.sum("length_pt").alias("len")).where(c("len") > 0)
            .groupBy("page_id").agg(F.max_by("ord", F.struct("len", -c("ord"))).alias("ord")))
    inside = hits.join(best, ["page_id", "ord"], "left_semi").select(*lines.columns)
    return inside.unionByName(lines.join(best, "page_id", "left_anti"))
