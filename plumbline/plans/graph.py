"""Wall network and room face queries on drawn room lattices with known answers."""

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import graph as op
from plumbline.plans.oracle import CTES
from plumbline.plans.registry import query

c = F.col
SEG = ("cells", "segments")


def drawn(t):
    """Even pages: cell walls with slightly overshooting ends.  Odd pages: full-length lines with a door gap."""
    even = t.segments.where(c("page_id").cast("bigint") % 2 == 0).select(
        "page_id", "x1", "y1", (c("x2") + F.when(c("side") == 0, 0.6).otherwise(0.0)).alias("x2"), "y2")
    first = t.cells.where((c("page_id").cast("bigint") % 2 == 1) & (c("cell_id") % 12 == 0)).select(
        "page_id", (c("x2") - c("x1")).alias("w"), (c("y2") - c("y1")).alias("h"))
    left, low = F.lit(40.0), F.lit(50.0)
    row = lambda k: low + c("h") * k
    line = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    right, top = left + c("w") * 4, low + c("h") * 3
    door = left + c("w") * 1.3
    walls = [line(left, row(k), right, row(k)) for k in (0, 2, 3)]
    walls += [line(left, row(1), door, row(1)), line(door + 30, row(1), right, row(1))]
    walls += [line(left + c("w") * k, low, left + c("w") * k, top) for k in range(5)]
    odd = first.select("page_id", F.inline(F.array(*walls)))
    return even.unionByName(odd)


def pages(t):
    return t.cells.select("page_id").distinct().select("page_id", F.lit(1224.0).alias("page_w"), F.lit(792.0).alias("page_h"))


@query("room_faces", ("cells",), "SELECT page_id, x1, y1, x2, y2 FROM cells")
def _faces(t):
    whole = lambda col: F.round(col, 0)  # noqa: E731 - ends were moved by at most 0.3
    return op.room_faces(drawn(t), pages(t)).select(
        "page_id", whole("box.x0").alias("x1"), whole("box.y0").alias("y1"), whole("box.x1").alias("x2"), whole("box.y1").alias("y2"))


@query("face_areas", ("cells",), "SELECT page_id, (x2-x1)*(y2-y1) AS area, count(*) AS n FROM cells GROUP BY 1, 2")
def _areas(t):
    edges = op.distinct_segments(t.segments)
    found = op.faces(op.half_edges(edges)).where(c("area") > 0)
    return found.groupBy("page_id", G.area(c("polygon")).alias("area")).agg(F.count(F.lit(1)).alias("n"))


STAIRS = """
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS page_id, 14 + o_orderkey % 36 AS steps FROM orders)
SELECT page_id, CAST(2*steps + 2 AS BIGINT) AS vertices, CAST(200.0*steps*(steps+1) AS DOUBLE) AS area FROM o"""


@query("many_corner_rooms", (), STAIRS)
def _stairs(t):
    """One staircase-shaped room of 30 to 100 corners per order: no face is too long to be walked."""
    steps = (14 + c("o_orderkey") % 36).cast("int")
    base = t.raw("orders").select(c("o_orderkey").cast("string").alias("page_id"), steps.alias("n"))
    i = c("i") * 20.0
    tread = base.select("page_id", F.explode(F.sequence(F.lit(0), c("n") - 1)).alias("i")).select("page_id", F.inline(F.array(
        F.struct(i.alias("x1"), i.alias("y1"), (i + 20).alias("x2"), i.alias("y2")),
        F.struct((i + 20).alias("x1"), i.alias("y1"), (i + 20).alias("x2"), (i + 20).alias("y2")))))
    side, zero = c("n") * 20.0, F.lit(0.0)
    sides = base.select("page_id", F.inline(F.array(
        F.struct(side.alias("x1"), side.alias("y1"), zero.alias("x2"), side.alias("y2")),
        F.struct(zero.alias("x1"), side.alias("y1"), zero.alias("x2"), zero.alias("y2")))))
    found = op.faces(op.half_edges(tread.unionByName(sides))).where(c("area") > 0)
    return found.select("page_id", "vertices", "area")


@query("wall_components", SEG, """
SELECT page_id, count(*) AS edges, sum(len) AS component_len, CAST(1 AS BIGINT) AS components FROM (
SELECT DISTINCT page_id, x1, y1, x2, y2, abs(x2-x1)+abs(y2-y1) AS len FROM segments) GROUP BY 1""")
def _components(t):
    marked = op.wall_components(op.distinct_segments(t.segments))
    per = marked.groupBy("page_id", "component").agg(F.count(F.lit(1)).alias("edges"), F.max("component_len").alias("len"))
    return per.groupBy("page_id").agg(F.sum("edges").alias("edges"), F.sum("len").alias("component_len"),
                                      F.count(F.lit(1)).alias("components"))


@query("distinct_segments", SEG, "SELECT DISTINCT page_id, x1, y1, x2, y2 FROM segments")
def _distinct(t):
    flipped = t.segments.select("page_id", c("x2").alias("x1"), c("y2").alias("y1"), c("x1").alias("x2"), c("y1").alias("y2"))
    return op.distinct_segments(t.segments.select(*flipped.columns).unionByName(flipped))


@query("snap_segments", SEG, """
SELECT page_id, count(DISTINCT (x1, y1, x2, y2)) AS n FROM segments GROUP BY 1""")
def _snap(t):
    """Ends spread by up to 0.9 pt come back together: as many different walls as before."""
    shaken = t.segments.select("page_id", (c("x1") + c("tag") % 4 * 0.3).alias("x1"), "y1", (c("x2") + c("tag") % 3 * 0.3).alias("x2"), "y2")
    return op.distinct_segments(op.snap_segments(shaken)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("merge_collinear", ("cells",), """
SELECT page_id, min(x1) AS x1, y AS y1, max(x2) AS x2, y AS y2 FROM (SELECT page_id, x1, x2, y1 AS y FROM cells UNION ALL SELECT page_id, x1, x2, y2 FROM cells) GROUP BY 1, 3
UNION ALL SELECT page_id, x, min(y1), x, max(y2) FROM (SELECT page_id, y1, y2, x1 AS x FROM cells UNION ALL SELECT page_id, y1, y2, x2 FROM cells) GROUP BY 1, 2""")
def _merge(t):
    return op.distinct_segments(op.merge_collinear(t.segments.select("page_id", "x1", "y1", "x2", "y2")))


@query("gap_bridges", ("cells",), """
SELECT page_id, x2-30.0 AS x1, y1, x2 FROM cells WHERE cell_id % 4 <> 3""")
def _gaps(t):
    """Every cell's lower wall is drawn 30 pt short: a gap to the neighbour on its right."""
    low = t.cells.select("page_id", "x1", "y1", (c("x2") - 30).alias("x2"), c("y1").alias("y2"))
    return op.gap_bridges(low).select("page_id", "x1", "y1", "x2")


@query("door_gaps", ("cells",), """
SELECT page_id, x2-30.0 AS x1, y1 FROM cells WHERE cell_id % 4 <> 3 AND (tag % 3 = 0 OR page_id NOT IN (SELECT page_id FROM cells WHERE tag % 3 = 0))""")
def _doors(t):
    low = t.cells.select("page_id", "x1", "y1", (c("x2") - 30).alias("x2"), c("y1").alias("y2"))
    doors = t.cells.where(c("tag") % 3 == 0).select("page_id", (c("x2") - 20).alias("x"), (c("y1") + 9).alias("y"))
    return op.with_door_evidence(op.gap_bridges(low), doors).select("page_id", "x1", "y1")


@query("split_segments", ("cells",), """
SELECT page_id, x1, y1, x2, y2 FROM (SELECT DISTINCT page_id, x1, y1, x2, y1 AS y2 FROM cells UNION SELECT page_id, x1, y2, x2, y2 FROM cells
UNION SELECT page_id, x1, y1, x1, y2 FROM cells UNION SELECT page_id, x2, y1, x2, y2 FROM cells)""")
def _split(t):
    """Full-length lines fall back into the cell walls."""
    whole = op.merge_collinear(t.segments.select("page_id", "x1", "y1", "x2", "y2"))
    parts = op.distinct_segments(op.split_segments(whole))
    return parts.select("page_id", *[F.round(n, 6).alias(n) for n in ("x1", "y1", "x2", "y2")])


@query("prune_walls", SEG, """
SELECT page_id, count(*) AS n FROM (SELECT DISTINCT page_id, x1, y1, x2, y2 FROM segments) GROUP BY 1""")
def _prune(t):
    """Two-step spurs and a far-away scrap are added to every page and must go again."""
    base = t.segments.select("page_id", "x1", "y1", "x2", "y2")
    corner = t.cells.where(c("cell_id") % 12 == 0).select("page_id", c("x1").alias("x"), c("y1").alias("y"))
    noise = corner.select("page_id", F.inline(F.array(
        F.struct(c("x").alias("x1"), c("y").alias("y1"), (c("x") - 4).alias("x2"), (c("y") - 4).alias("y2")),
        F.struct((c("x") - 4).alias("x1"), (c("y") - 4).alias("y1"), (c("x") - 9).alias("x2"), (c("y") - 4).alias("y2")),
        F.struct(F.lit(900.0).alias("x1"), F.lit(700.0).alias("y1"), F.lit(930.0).alias("x2"), F.lit(700.0).alias("y2")))))
    edges = op.distinct_segments(base.unionByName(noise))
    return op.prune_components(op.prune_stubs(edges)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("clean_walls", ("cells",), """
SELECT page_id, sum(len) AS len FROM (SELECT DISTINCT page_id, x1, y1, x2-x1 AS len, 0 AS k FROM cells UNION SELECT page_id, x1, y2, x2-x1, 0 FROM cells
UNION SELECT page_id, x1, y1, y2-y1, 1 FROM cells UNION SELECT page_id, x2, y1, y2-y1, 1 FROM cells) GROUP BY 1""")
def _clean(t):
    return op.clean_walls(drawn(t).where(c("page_id").cast("bigint") % 2 == 1).unionByName(
        t.segments.where(c("page_id").cast("bigint") % 2 == 0).select("page_id", "x1", "y1", "x2", "y2"))).groupBy("page_id").agg(
        F.round(F.sum(F.hypot(c("x2") - c("x1"), c("y2") - c("y1"))), 3).alias("len"))


#: Every room of a page on its own, apart from its neighbours; those with slot 1 mod 3 miss their left wall, which stands 3 pt up.
def lone_rooms(t):
    slot = F.floor(c("seg_id") / 4).cast("bigint") % 12
    dx, dy = (slot % 4) * 200.0, F.floor(slot / 4) * 200.0
    lift = F.when((slot % 3 == 1) & (c("side") == 3), 3.0).otherwise(0.0)
    return t.segments.select("page_id", (c("x1") + dx).alias("x1"), (c("y1") + dy + lift).alias("y1"),
                             (c("x2") + dx).alias("x2"), (c("y2") + dy + lift).alias("y2"))


LONE = """lone AS (SELECT page_id, cell_id % 12 AS slot, x1 + (cell_id % 12 % 4)*200 AS x1, y1 + (cell_id % 12 // 4)*200 AS y1,
 x2 + (cell_id % 12 % 4)*200 AS x2, y2 + (cell_id % 12 // 4)*200 AS y2 FROM cells)"""


@query("wall_runs", ("cells",), f"""
WITH {LONE}
SELECT page_id, count(*)*4 AS edges, round(sum(x2-x1+y2-y1)*2, 3) AS length_pt,
 count(*) + count(*) FILTER (slot % 3 = 1) AS runs, count(*) FILTER (slot % 3 <> 1) AS closed FROM lone GROUP BY 1""")
def _runs(t):
    """Closed rooms are one closed run each; where a wall is out of place there are two open ones."""
    runs = op.run_summary(op.wall_runs(op.distinct_segments(lone_rooms(t))))
    return runs.groupBy("page_id").agg(F.sum("edges").alias("edges"), F.round(F.sum("length_pt"), 3).alias("length_pt"),
                                       F.count(F.lit(1)).alias("runs"), F.count_if("closed").alias("closed"))


@query("run_points", ("cells",), f"""
WITH {LONE}
SELECT page_id, CAST(n AS BIGINT) AS pos, round(CASE WHEN n IN (1, 2) THEN x2 ELSE x1 END, 3) AS x, round(CASE WHEN n IN (2, 3) THEN y2 ELSE y1 END, 3) AS y
FROM lone, range(0, 4) r(n) WHERE slot % 3 = 1
UNION ALL SELECT page_id, CAST(n AS BIGINT), round(x1, 3), round(CASE WHEN n = 0 THEN y1 ELSE y2 END + 3, 3) FROM lone, range(0, 2) r(n) WHERE slot % 3 = 1
UNION ALL SELECT page_id, CAST(n AS BIGINT), round(CASE WHEN n IN (2, 3) THEN x2 ELSE x1 END, 3), round(CASE WHEN n IN (1, 2) THEN y2 ELSE y1 END, 3)
FROM lone, range(0, 5) r(n) WHERE slot % 3 <> 1""")
def _run_points(t):
    """Open rooms: four points from the lower left corner round; closed ones: up the left side and round to the start."""
    return op.run_points(op.wall_runs(op.distinct_segments(lone_rooms(t)))).select(
        "page_id", c("pos").cast("bigint").alias("pos"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("filter_stray", SEG, """
SELECT page_id, CAST(2 AS BIGINT) AS dropped FROM cells GROUP BY 1""")
def _stray(t):
    base = t.segments.select("page_id", "x1", "y1", "x2", "y2")
    corner = t.cells.where(c("cell_id") % 12 == 0).select("page_id")
    noise = corner.select("page_id", F.inline(F.array(
        F.struct(F.lit(1100.0).alias("x1"), F.lit(700.0).alias("y1"), F.lit(1130.0).alias("x2"), F.lit(700.0).alias("y2")),
        F.struct(F.lit(1000.0).alias("x1"), F.lit(10.0).alias("y1"), F.lit(1000.0).alias("x2"), F.lit(780.0).alias("y2")))))
    return op.filter_stray(op.distinct_segments(base.unionByName(noise))).groupBy("page_id").agg(
        F.count_if(~c("kept")).alias("dropped"))


@query("trace_confidence", SEG, """
SELECT cell_id, round(greatest(0.55, least(0.95, 0.55+0.4*(x2-x1)/max(x2-x1) OVER (PARTITION BY tag % 10))), 6) AS confidence FROM cells""")
def _confidence(t):
    runs = t.cells.select((c("tag") % 10).cast("string").alias("page_id"), "cell_id", (c("x2") - c("x1")).alias("length_pt"))
    return op.trace_confidence(runs).select("cell_id", F.round("confidence", 6).alias("confidence"))
