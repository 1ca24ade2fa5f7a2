"""Spatial queries on drawn room lattices with known answers."""

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import geometry as op
from plumbline.plans.registry import query

c = F.col
CELLS = ("cells",)


def midx():
    return (c("x1") + c("x2")) / 2


def midy():
    return (c("y1") + c("y2")) / 2


def box():
    return F.struct(c("x1").alias("x0"), c("y1").alias("y0"), c("x2").alias("x1"), c("y2").alias("y1"))


def rooms(t):
    """Every cell as a face, and one face around all cells of the page."""
    ring = G.rectangle(c("x1"), c("y1"), c("x2"), c("y2"))
    cell = t.cells.select("page_id", c("cell_id").cast("string").alias("face"), ((c("x2") - c("x1")) * (c("y2") - c("y1"))).alias("area"),
                          box().alias("box"), ring.alias("polygon"))
    hull = t.cells.groupBy("page_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return cell.unionByName(hull.select("page_id", F.lit("all").alias("face"), ((c("x2") - c("x1")) * (c("y2") - c("y1"))).alias("area"),
                                        box().alias("box"), ring.alias("polygon")))


@query("polygon_facts", CELLS, """
SELECT cell_id, w*h AS gross, floor(greatest(0.0, w*h-(w+h))*10+0.5)/10 AS net, (w+h)*2 AS perimeter, w*h/2 AS half, round((x1+w/4)/1224, 9) AS nx, round(1-y2/792, 9) AS ny,
 round((w+h)/18, 9) AS path FROM (SELECT *, x2-x1 AS w, y2-y1 AS h FROM cells)""")
def _polygon(t):
    ring = G.rectangle(c("x1"), c("y1"), c("x2"), c("y2"))
    w, h = F.lit(1224.0), F.lit(792.0)
    tri = F.slice(ring, 1, 3)
    inner = F.array(F.struct((c("x1") + (c("x2") - c("x1")) / 4).alias("x"), c("y2").alias("y")))
    page = G.to_page(inner, w, h)
    return t.cells.select("cell_id", G.net_gross(ring).alias("g"), G.area(tri).alias("half"), page.alias("p"),
                          F.round(G.polyline_ft(G.to_page(tri, w, h, clamp=False), w, h, F.lit(18.0)), 9).alias("path")).select(
        "cell_id", "g.gross", "g.net", "g.perimeter", "half", F.round(c("p")[0].x, 9).alias("nx"), F.round(c("p")[0].y, 9).alias("ny"), "path")


@query("box_iou", CELLS, """
SELECT cell_id, round(0.75/1.25, 9) AS iou, x1+(x2-x1)*0.25 AS clip_x0, x2+(x2-x1)*0.25 AS union_x1, round(greatest(0.01, least(0.09, sqrt(greatest(16.0, (x2-x1)*(y2-y1)))/250)), 9) AS half FROM cells""")
def _iou(t):
    moved = F.struct((c("x1") + (c("x2") - c("x1")) * 0.25).alias("x0"), c("y1").alias("y0"), (c("x2") + (c("x2") - c("x1")) * 0.25).alias("x1"), c("y2").alias("y1"))
    return t.cells.withColumn("a", box()).withColumn("b", moved).select(
        "cell_id", F.round(G.iou(c("a"), c("b")), 9).alias("iou"), G.box_clip(c("a"), c("b")).x0.alias("clip_x0"),
        G.box_union(c("a"), c("b")).x1.alias("union_x1"), F.round(G.marker_half((c("x2") - c("x1")) * (c("y2") - c("y1"))), 9).alias("half"))


@query("segment_kinds", ("cells",), """
SELECT cell_id, CASE tag % 5 WHEN 0 THEN 'horizontal' WHEN 1 THEN 'vertical' WHEN 2 THEN 'door' WHEN 3 THEN 'diagonal' ELSE 'drop' END AS kind FROM cells""")
def _kinds(t):
    k = c("tag") % 5
    dx = F.when(k == 0, 80.0).when(k == 1, 0.5).when(k == 2, 20.0).when(k == 3, 60.0).otherwise(2.0)
    dy = F.when(k == 0, 1.0).when(k == 1, 80.0).when(k == 2, 20.0).when(k == 3, 60.0).otherwise(2.0)
    return t.cells.select("cell_id", G.segment_kind(c("x1"), c("y1"), c("x1") + dx, c("y1") + dy).alias("kind"))


@query("enclosing_face", CELLS, "SELECT page_id, cell_id AS point_id, CAST(cell_id AS VARCHAR) AS face FROM cells")
def _enclosing(t):
    points = t.cells.select("page_id", c("cell_id").alias("point_id"), (midx() + c("tag") % 9).alias("x"), midy().alias("y"))
    return op.enclosing_face(points, rooms(t)).select("page_id", "point_id", "face")


@query("label_faces", CELLS, """
SELECT page_id, cell_id*2 AS ord, CAST(cell_id AS VARCHAR) AS face FROM cells
UNION ALL SELECT page_id, min(cell_id)*2+1, 'all' FROM cells GROUP BY 1""")
def _label_faces(t):
    """One label per room, and a second one in each page's first room that must take the outer face."""
    labels = t.cells.select("page_id", (c("cell_id") * 2).alias("ord"), "x1", "y1", "x2", "y2", "cell_id")
    extra = labels.where(c("cell_id") % 12 == 0).withColumn("ord", c("ord") + 1)
    both = labels.unionByName(extra).select("page_id", "ord", midx().alias("cx"), midy().alias("cy"), (midx() - 5).alias("x0"), (midy() - 5).alias("y0"),
                                            (midx() + 5).alias("x1"), (midy() + 5).alias("y1"))
    return op.label_faces(both, rooms(t), F.lit(60.0))


@query("shared_faces", CELLS, """
SELECT page_id, cell_id AS ord, row_number() OVER (PARTITION BY page_id, tag % 3 ORDER BY cell_id) > 1 AS shared FROM cells""")
def _shared(t):
    assigned = t.cells.select("page_id", c("cell_id").alias("ord"), (c("tag") % 3).alias("face"))
    return op.shared_faces(assigned).select("page_id", "ord", "shared")


def marks(t):
    """One dimension note per cell, off its centre."""
    return t.cells.select("page_id", c("cell_id").alias("seq"), (midx() + c("tag") % 40).alias("x"), (midy() + 3).alias("y"),
                          ((c("x2") - c("x1")) / 10 * F.when(c("tag") % 2 == 0, 1.1).otherwise(2.0)).alias("length_ft"),
                          F.when(c("tag") % 3 == 0, "v").otherwise("h").alias("orientation"))


def boxes(t):
    return t.cells.select("page_id", c("cell_id").alias("room_id"), box().alias("box"), F.lit(10.0).alias("pt_per_foot"))


PAIRS = """
WITH m AS (SELECT page_id, cell_id AS seq, (x1+x2)/2 + tag % 40 AS x, (y1+y2)/2+3 AS y, (x2-x1)/10*(CASE WHEN tag % 2 = 0 THEN 1.1 ELSE 2.0 END)::DOUBLE AS len, tag % 3 = 0 AS up FROM cells),
p AS (SELECT c.page_id, c.cell_id AS room_id, m.seq, m.len, m.up, power(m.x-(c.x1+c.x2)/2, 2)+power(m.y-(c.y1+c.y2)/2, 2) AS dist2, (c.x2-c.x1)/10 AS bw, (c.y2-c.y1)/10 AS bh
  FROM cells c JOIN m ON m.page_id=c.page_id AND m.x BETWEEN c.x1-30 AND c.x2+30 AND m.y BETWEEN c.y1-30 AND c.y2+30)
"""


@query("room_callouts", CELLS, PAIRS + "SELECT page_id, room_id, seq, dist2 FROM p")
def _room_callouts(t):
    return op.room_callouts(boxes(t).drop("pt_per_foot"), marks(t)).select("page_id", "room_id", "seq", "dist2")


@query("nearest_callouts", CELLS, PAIRS + """SELECT page_id, room_id, seq, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id, room_id ORDER BY dist2, seq) AS rank FROM p) WHERE rank <= 2""")
def _nearest(t):
    return op.nearest_callouts(op.room_callouts(boxes(t).drop("pt_per_foot"), marks(t)), 2).select("page_id", "room_id", "seq", "rank")


@query("room_dimensions", CELLS, PAIRS + """
SELECT c.page_id, c.cell_id AS room_id, round(coalesce(w, (x2-x1)/10), 6) AS width_ft, round(coalesce(h, (y2-y1)/10), 6) AS height_ft, coalesce(n, 0) AS callouts,
  CASE WHEN w IS NOT NULL AND h IS NOT NULL THEN 'callouts' WHEN w IS NULL AND h IS NULL THEN 'bbox' ELSE 'mixed' END AS source FROM cells c LEFT JOIN (
SELECT page_id, room_id, count(*) AS n, max(CASE WHEN NOT up AND abs(len-bw)/greatest(1.0, bw) <= 0.25 THEN len END) AS w, max(CASE WHEN up AND abs(len-bh)/greatest(1.0, bh) <= 0.25 THEN len END) AS h
FROM p GROUP BY 1, 2) q ON q.page_id=c.page_id AND q.room_id=c.cell_id""")
def _dimensions(t):
    pairs = op.room_callouts(boxes(t).drop("pt_per_foot"), marks(t))
    return op.room_dimensions(boxes(t), pairs).select("page_id", "room_id", F.round("width_ft", 6).alias("width_ft"),
                                                      F.round("height_ft", 6).alias("height_ft"), "callouts", "source")


@query("snap_points", ("cells", "segments"), """
WITH p AS (SELECT page_id, cell_id AS point_id, x1 + tag % 23 AS x, y1 + tag % 7 AS y FROM cells),
o AS (SELECT point_id, CASE WHEN sqrt(power(x1-x, 2)+power(y1-y, 2)) < 8 OR sqrt(power(x2-x, 2)+power(y2-y, 2)) < 8 THEN 0 WHEN x1=x2 AND y > y1 AND y < y2 AND abs(x-x1) < 5 THEN 1 WHEN y1=y2 AND x > x1 AND x < x2 AND abs(y-y1) < 5 THEN 1 END AS k
  FROM p JOIN segments s ON s.page_id=p.page_id)
SELECT point_id, CASE min(k) WHEN 0 THEN 'endpoint' ELSE 'edge' END AS snap FROM o WHERE k IS NOT NULL GROUP BY 1""")
def _snap(t):
    points = t.cells.select("page_id", c("cell_id").alias("point_id"), (c("x1") + c("tag") % 23).alias("x"), (c("y1") + c("tag") % 7).alias("y"))
    return op.snap_points(points, t.segments, 8.0, 5.0).select("point_id", "snap")


@query("centerlines", CELLS, """
SELECT page_id, x1+15-7 AS x1, y1+20+(tag%16)/2.0 AS y1, x2-10+7 AS x2 FROM cells WHERE tag % 16 BETWEEN 3 AND 12""")
def _centerlines(t):
    face = t.cells.select("page_id", F.inline(F.array(
        F.struct((c("cell_id") * 2).alias("seg_id"), (c("x1") + 5).alias("x1"), (c("y1") + 20).alias("y1"), (c("x2") - 5).alias("x2"), (c("y1") + 20).alias("y2")),
        F.struct((c("cell_id") * 2 + 1).alias("seg_id"), (c("x1") + 15).alias("x1"), (c("y1") + 20 + c("tag") % 16).alias("y1"), (c("x2") - 10).alias("x2"),
                 (c("y1") + 20 + c("tag") % 16).alias("y2")))))
    return op.centerlines(face).select("page_id", "x1", "y1", "x2")


@query("drop_stacks", CELLS, """
SELECT page_id, cell_id*3+n AS seg_id FROM cells, range(0, 3) r(n) WHERE NOT ((n = 1 AND tag % 20 BETWEEN 3 AND 16) OR (n <> 1 AND tag % 20 BETWEEN 3 AND 8))""")
def _stacks(t):
    n = c("n")
    lines = t.cells.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        "page_id", (c("cell_id") * 3 + n).alias("seg_id"), (c("x1") + 5).alias("x1"), (c("y1") + 20 + n * (c("tag") % 20)).alias("y1"),
        (c("x2") - 5).alias("x2"), (c("y1") + 20 + n * (c("tag") % 20)).alias("y2"))
    return op.drop_stacks(lines).select("page_id", "seg_id")


@query("ray_rooms", CELLS, "SELECT page_id, cell_id AS label_id, x1, y1, x2, y2 FROM cells")
def _rays(t):
    labels = t.cells.select("page_id", c("cell_id").alias("label_id"), (midx() - 6).alias("x0"), (midy() - 4).alias("y0"), (midx() + 6).alias("x1"),
                            (midy() + 4).alias("y1"), F.lit(1224.0).alias("page_w"), F.lit(792.0).alias("page_h"))
    return op.ray_rooms(labels, t.segments, 20.0, 500.0, 40.0, 8.0).select(
        "page_id", "label_id", c("box.x0").alias("x1"), c("box.y0").alias("y1"), c("box.x1").alias("x2"), c("box.y1").alias("y2"))


@query("rectangles", CELLS, "SELECT page_id, x1, y1, x2, y2 FROM (SELECT page_id, floor(y1/1.5+0.5)*1.5 AS y1, floor(y2/1.5+0.5)*1.5 AS y2, x1, x2 FROM cells)")
def _rectangles(t):
    inner = t.cells.select(
        "page_id", (c("x1") + 6).alias("x1"), (c("y1") + 6).alias("y1"), (c("x2") - 6).alias("x2"), (c("y2") - 6).alias("y2"))
    side = F.inline(F.array(*[F.struct(a.alias("x1"), b.alias("y1"), d.alias("x2"), e.alias("y2")) for a, b, d, e in (
        (c("x1"), c("y1"), c("x2"), c("y1")), (c("x2"), c("y1"), c("x2"), c("y2")), (c("x1"), c("y2"), c("x2"), c("y2")),
        (c("x1"), c("y1"), c("x1"), c("y2")))]))
    walls = t.segments.select("page_id", "x1", "y1", "x2", "y2").unionByName(inner.select("page_id", side))
    found = op.rectangles(walls.withColumn("seg_id", F.lit(0)))
    return found.select("page_id", c("box.x0").alias("x1"), c("box.y0").alias("y1"), c("box.x1").alias("x2"), c("box.y1").alias("y2"))


@query("drop_overlaps", CELLS, "SELECT page_id, cell_id AS ord FROM cells WHERE cell_id % 12 % 2 = 0")
def _overlaps(t):
    """A row of boxes where each overlaps only the next one by more than half: every other one stays."""
    slot = (c("cell_id") % 12) * 10.0
    rows = t.cells.select("page_id", c("cell_id").alias("ord"), F.struct(
        slot.alias("x0"), F.lit(0.0).alias("y0"), (slot + 40).alias("x1"), F.lit(30.0).alias("y1")).alias("box"))
    return op.drop_overlaps(rows).select("page_id", "ord")


@query("near_duplicates", CELLS, "SELECT page_id, cell_id AS ord FROM cells WHERE cell_id % 12 % 2 = 0 OR cell_id % 12 = 11")
def _duplicates(t):
    """Labels 0.04 apart in a row; the last one reads differently."""
    slot = c("cell_id") % 12
    rows = t.cells.select("page_id", c("cell_id").alias("ord"), F.when(slot == 11, "other").otherwise("same").alias("key"),
                          (slot * 0.04).alias("x"), F.lit(0.5).alias("y"))
    return op.drop_near_duplicates(rows).select("page_id", "ord")


@query("label_clusters", CELLS, "SELECT page_id, 'TOP MID LOW' AS text, (x1+x2)/2+5 AS cx, (y1+y2)/2+4 AS cy FROM cells")
def _clusters(t):
    n = c("n")
    frags = t.cells.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        "page_id", (c("cell_id") * 3 + n).alias("seq"), F.element_at(F.array(F.lit("LOW"), F.lit("TOP "), F.lit("MID")), n + 1).alias("text"),
        midx().alias("x"), (midy() + F.element_at(F.array(F.lit(-15.0), F.lit(15.0), F.lit(0.0)), n + 1)).alias("y"), F.lit(10.0).alias("width"), F.lit(8.0).alias("height"))
    return op.label_clusters(frags).select("page_id", "text", "cx", "cy")


@query("densest_column", CELLS, """
WITH l AS (SELECT page_id, (tag % 10)/16.0 AS x FROM cells),
n AS (SELECT a.page_id, a.x, count(*) AS near FROM (SELECT DISTINCT page_id, x FROM l) a JOIN l b ON b.page_id=a.page_id AND abs(b.x-a.x) <= 0.05 GROUP BY 1, 2)
SELECT page_id, round(max(near)/12.0, 6)::DOUBLE AS share, max(near)/12.0 >= 0.8 AS side_panel, max(near)/12.0 >= 0.5 AS drop_cluster FROM n GROUP BY 1""")
def _column(t):
    labels = t.cells.select("page_id", (c("tag") % 10 / 16).alias("x"))
    return op.densest_column(labels).withColumn("share", F.round("share", 6))


@query("largest_labels", CELLS, """
SELECT page_id, cell_id AS seq, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY tag % 9 DESC, cell_id) AS INT) AS rank FROM cells) WHERE rank <= 5""")
def _largest(t):
    labels = t.cells.select("page_id", c("cell_id").alias("seq"), (c("tag") % 9).alias("font_size"))
    return op.largest_labels(labels, 5).select("page_id", "seq", "rank")


@query("best_region", CELLS, """
SELECT page_id, cell_id AS line_id FROM cells c JOIN (SELECT page_id AS p, sum(CASE WHEN cell_id % 12 < 6 THEN x2-x1+tag ELSE 0 END) AS a, sum(CASE WHEN cell_id % 12 >= 6 THEN x2-x1+tag ELSE 0 END) AS b FROM cells GROUP BY 1) s ON s.p=page_id
WHERE (a >= b) = (cell_id % 12 < 6)""")
def _region(t):
    lines = t.cells.select("page_id", c("cell_id").alias("line_id"), ((c("cell_id") % 12) / 12.0).alias("mx"), F.lit(0.5).alias("my"),
                           (c("x2") - c("x1") + c("tag")).alias("length_pt"))
    area = lambda a, b: F.struct(F.lit(a).alias("x0"), F.lit(0.0).alias("y0"), F.lit(b).alias("x1"), F.lit(1.0).alias("y1"))
    regions = t.cells.select("page_id").distinct().select("page_id", F.posexplode(F.array(area(0.0, 0.45), area(0.48, 1.0))).alias("ord", "box"))
    return op.best_region(lines, regions, 0.02).select("page_id", "line_id")
