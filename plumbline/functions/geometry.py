"""Geometry on arrays of points: areas, boxes, containment, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POINTS = "array<struct<x:double,y:double>>"


def _next(points: Column) -> Column:
    """The points rotated by one: each edge's other end."""
    return F.concat(F.slice(points, 2, F.greatest(F.lit(0), F.size(points) - 1)), F.slice(points, 1, 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(points: Column) -> Column:
    """Shoelace area, positive for a counter-clockwise ring."""
    return _sum(F.zip_with(points, _next(points), lambda a, b: a.x * b.y - b.x * a.y)) / 2


def area(points: Column) -> Column:
    return F.abs(signed_area(points))


def perimeter(points: Column) -> Column:
    return _sum(F.zip_with(points, _next(points), lambda a, b: F.hypot(b.x - a.x, b.y - a.y)))


def scaled(points: Column, sx: Column, sy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p.x * sx).alias("x"), (p.y * sy).alias("y")))


def net_gross(points: Column, thickness: float = 0.5) -> Column:
    """Gross area, area inside the wall band, and perimeter, to one decimal."""
    tenth = lambda v: F.floor(v * 10 + 0.5) / 10
    solid = F.size(points) >= 3
    gross, run = area(points), perimeter(points)
    value = lambda v: F.when(solid, tenth(v)).otherwise(0.0)
    return F.struct(value(gross).alias("gross"), value(F.greatest(F.lit(0.0), gross - run * thickness)).alias("net"),
                    value(run).alias("perimeter"))


def bbox(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"),
                    F.array_max(ys).alias("y1"))


def contains_point(points: Column, x: Column, y: Column) -> Column:
    """Even-odd rule."""
    crossed = F.zip_with(points, _next(points), lambda a, b: (
        ((a.y > y) != (b.y > y)) & (x < (a.x - b.x) * (y - b.y) / F.when(a.y != b.y, a.y - b.y) + b.x)))
    return F.size(F.filter(crossed, lambda hit: F.coalesce(hit, F.lit(False)))) % 2 == 1


def in_box(x: Column, y: Column, box: Column, slack: float = 0.0) -> Column:
    return x.between(box.x0 - slack, box.x1 + slack) & y.between(box.y0 - slack, box.y1 + slack)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    w = F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    h = F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    size = lambda r: (r.x1 - r.x0) * (r.y1 - r.y0)
    return F.coalesce(F.try_divide(w * h, size(a) + size(b) - w * h), F.lit(0.0))


def box_union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a.x0, b.x0).alias("x0"), F.least(a.y0, b.y0).alias("y0"),
                    F.greatest(a.x1, b.x1).alias("x1"), F.greatest(a.y1, b.y1).alias("y1"))


def box_clip(a: Column, b: Column) -> Column:
    return F.struct(F.greatest(a.x0, b.x0).alias("x0"), F.greatest(a.y0, b.y0).alias("y0"),
                    F.least(a.x1, b.x1).alias("x1"), F.least(a.y1, b.y1).alias("y1"))


def to_page(points: Column, page_w: Column, page_h: Column, clamp: bool = True) -> Column:
    """Points (y-up) to normalised page coordinates (y-down); the extractor clamps, the routes do not."""
    def fit(v: Column) -> Column:
        return F.greatest(F.lit(0.005), F.least(F.lit(0.995), v)) if clamp else v
    return F.transform(points, lambda p: F.struct(fit(p.x / page_w).alias("x"), fit(1 - p.y / page_h).alias("y")))


def from_page(points: Column, page_w: Column, page_h: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p.x * page_w).alias("x"), ((1 - p.y) * page_h).alias("y")))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def marker_half(area_sqft: Column) -> Column:
    """Half side of the square that marks a room without geometry."""
    return F.greatest(F.lit(0.01), F.least(F.lit(0.09), F.sqrt(F.greatest(F.lit(16.0), area_sqft)) / 250))


def polyline_ft(points: Column, page_w: Column, page_h: Column, pt_per_foot: Column) -> Column:
    """Length in feet of an open path in normalised coordinates (F8)."""
    ends = F.slice(points, 2, F.greatest(F.lit(0), F.size(points) - 1))
    starts = F.slice(points, 1, F.greatest(F.lit(0), F.size(points) - 1))
    steps = F.zip_with(starts, ends, lambda a, b: F.hypot((b.x - a.x) * page_w, (b.y - a.y) * page_h))
    return _sum(steps) / pt_per_foot


def segment_kind(x1: Column, y1: Column, x2: Column, y2: Column, axis_tol: float = 1.5) -> Column:
    """What a drawn line may be (C15): too short, wall, door leaf or diagonal wall."""
    dx, dy = F.abs(x2 - x1), F.abs(y2 - y1)
    length = F.hypot(dx, dy)
    return (F.when(length < 5, "drop").when(dy < axis_tol, "horizontal").when(dx < axis_tol, "vertical")
            .when(length.between(18, 45), "door").when(length >= 50, "diagonal").otherwise("drop"))
