"""Open zones on lattice plans without inner walls.

A page's kind says which cells share a zone: pairs without or with a wall stub between them, pairs whose right cell
is measured (rightly or at twice its area), whole rows, or two rows.  The walls of a zone are the box around its cells.
"""

from pyspark.sql import functions as F

from plumbline.operators import zones as op
from plumbline.plans.geometry import box, midx, midy
from plumbline.plans.oracle import CTES, NEEDS
from plumbline.plans.registry import query

c = F.col
WHOLE = ["x0", "y0", "x1", "y1"]


def zoned(t):
    """Cells with their kind, zone and label."""
    kind, slot = c("page_id").cast("bigint") % 5, c("cell_id") % 12
    row = F.floor(slot / 4)
    zone = F.when(kind == 3, row).when(kind == 4, F.floor(row / 2)).otherwise(F.floor(slot / 2))
    return t.cells.withColumn("kind", kind).withColumn("zone", zone.cast("int")).withColumn("slot", slot).withColumn(
        "label", F.when(c("tag") % 3 < 2, "KITCHEN").otherwise("BATH"))


def drawing(t):
    """Labels, walls, callouts and pages for ``open_zones``."""
    cells = zoned(t)
    center = (midx() + c("tag") % 9 - 4).alias("cx"), midy().alias("cy")
    known = (c("kind") == 2) & (c("slot") % 2 == 1)
    side = (c("x2") - c("x1")) * (c("y2") - c("y1")) / 100
    labels = cells.select("page_id", c("cell_id").alias("label_id"), c("label").alias("text"), *center, (~known).alias("failed"),
                          box().alias("box"), F.when(known, side * (1 + c("tag") % 2)).alias("area_sqft"))
    whole = cells.groupBy("page_id", "kind", "zone").agg(F.min("x1").alias("x0"), F.min("y1").alias("y0"), F.max("x2").alias("x1"),
                                                        F.max("y2").alias("y1"), F.min("cell_id").alias("first"),
                                                        F.min("x2").alias("border"), F.count(F.lit(1)).alias("n"))
    wall = lambda a, b, x, y, no: F.struct(a.alias("x1"), b.alias("y1"), x.alias("x2"), y.alias("y2"), F.lit(no).alias("side"))
    x0, y0, x1, y1 = (c(n) for n in WHOLE)
    middle, stub = (y0 + y1) / 2, c("border") + 6
    walls = whole.select("page_id", "first", F.explode(F.concat(
        F.array(wall(x0, y0, x1, y0, 0), wall(x1, y0, x1, y1, 1), wall(x0, y1, x1, y1, 2), wall(x0, y0, x0, y1, 3)),
        F.when((c("kind") == 1) & (c("n") == 2), F.array(wall(stub, middle - 20, stub, middle + 20, 4))).otherwise(F.array()))).alias("w")).select(
        "page_id", (c("first") * 8 + c("w.side")).alias("seg_id"), "w.x1", "w.y1", "w.x2", "w.y2")
    note = lambda no, dx, dy, ft, way: F.struct(F.lit(no).alias("no"), (c("cx") + dx).alias("x"), (c("cy") + dy).alias("y"),
                                                F.lit(ft).alias("length_ft"), F.lit(way).alias("orientation"))
    callouts = cells.where(c("tag") % 7 == 0).select("page_id", "cell_id", *center).select(
        "page_id", "cell_id", F.explode(F.array(note(0, 5.0, 20.0, 7.0, "h"), note(1, -5.0, -20.0, 6.5, "v"))).alias("k")).select(
        "page_id", (c("cell_id") * 2 + c("k.no")).alias("seq"), "k.x", "k.y", "k.length_ft", "k.orientation")
    envelope = cells.groupBy("page_id").agg(F.struct(F.min("x1").alias("x0"), F.min("y1").alias("y0"), F.max("x2").alias("x1"), F.max("y2").alias("y1")).alias("envelope"))
    pages = envelope.select("page_id", F.lit(1224.0).alias("page_w"), F.lit(792.0).alias("page_h"), F.lit(10.0).alias("pt_per_foot"), "envelope")
    return labels, walls, callouts, pages


CTES["zoned"] = """
  SELECT *, (x1+x2)/2 + tag % 9 - 4 AS cx, (y1+y2)/2 AS cy, kind = 2 AND slot % 2 = 1 AS known, CASE WHEN tag % 3 < 2 THEN 'KITCHEN' ELSE 'BATH' END AS label,
    CASE WHEN tag % 3 < 2 THEN 60.0 ELSE 15.0 END::DOUBLE AS least, CASE kind WHEN 3 THEN slot // 4 WHEN 4 THEN slot // 8 ELSE slot // 2 END AS zone
  FROM (SELECT *, CAST(page_id AS BIGINT) % 5 AS kind, cell_id % 12 AS slot FROM cells)"""
CTES["zone_boxes"] = """
  SELECT page_id, zone, kind, min(x1) AS zx0, min(y1) AS zy0, max(x2) AS zx1, max(y2) AS zy1, min(x2) AS border, count(*) AS n,
    greatest(max(x2)-min(x1), max(y2)-min(y1)) / least(max(x2)-min(x1), max(y2)-min(y1)) <= 5 AS reached FROM zoned GROUP BY 1, 2, 3"""
CTES["zone_parts"] = """
  SELECT page_id, zone, kind, cell_id, label, known, tag, least, x1, y1, x2, y2, px0, px1, zy0, zy1, floor((px1-px0)+0.5)/10 AS w, floor((zy1-zy0)+0.5)/10 AS h, mw, mh,
    reached AND n <= 4 AS divided FROM (
  SELECT *, CASE WHEN before IS NULL THEN zx0 WHEN kind = 1 AND n = 2 THEN border + 6 ELSE (before + cx) / 2 END AS px0,
    CASE WHEN after IS NULL THEN zx1 WHEN kind = 1 AND n = 2 THEN border + 6 ELSE (cx + after) / 2 END AS px1 FROM (
  SELECT z.*, b.* EXCLUDE (page_id, zone, kind), lag(cx) OVER (PARTITION BY z.page_id, z.zone ORDER BY cx) AS before,
    lead(cx) OVER (PARTITION BY z.page_id, z.zone ORDER BY cx) AS after FROM zoned z JOIN zone_boxes b ON z.page_id = b.page_id AND z.zone = b.zone)) p
  LEFT JOIN (SELECT z.page_id AS mp, z.cell_id AS mc, max(CASE way WHEN 'h' THEN ft END) AS mw, max(CASE way WHEN 'v' THEN ft END) AS mh
    FROM zoned z JOIN (SELECT page_id, cx+5 AS x, cy+20 AS y, 7.0::DOUBLE AS ft, 'h' AS way FROM zoned WHERE tag % 7 = 0
                       UNION ALL SELECT page_id, cx-5, cy-20, 6.5, 'v' FROM zoned WHERE tag % 7 = 0) k
      ON z.page_id = k.page_id AND (k.x-z.cx)*(k.x-z.cx) + (k.y-z.cy)*(k.y-z.cy) <= 22500 GROUP BY 1, 2) ON mp = page_id AND mc = cell_id"""
CTES["zone_sizes"] = """
  SELECT *, w*h >= least*0.7 AND w*h <= least*10 AND greatest(w,h)/least(w,h) <= 4 AS ok, coalesce(mw*mh >= least*0.7 AND mw*mh <= least*5
    AND (mw*mh/(w*h) < 0.5 OR mw*mh/(w*h) > 1.5), false) AS printed, abs(w-mw)/mw+abs(h-mh)/mh < abs(w-mh)/mh+abs(h-mw)/mw AS straight FROM zone_parts WHERE divided"""
CTES["zone_results"] = """
  SELECT page_id, cell_id AS label_id, label, known AS replaced, tag, x1, y1, x2, y2, printed, px0, px1, zy0, zy1, CASE WHEN NOT printed THEN w WHEN straight THEN mw ELSE mh END AS width_ft,
    CASE WHEN NOT printed THEN h WHEN straight THEN mh ELSE mw END AS height_ft FROM zone_sizes WHERE ok"""
NEEDS |= {"zoned": ["cells"], "zone_boxes": ["zoned"], "zone_parts": ["zone_boxes"], "zone_sizes": ["zone_parts"], "zone_results": ["zone_sizes"]}


@query("open_zones", ("zone_results",), """
SELECT page_id, label_id, label, px0 AS x0, zy0 AS y0, px1 AS x1, zy1 AS y1, width_ft, height_ft, floor(width_ft*height_ft*10+0.5)/10 AS area_sqft,
  floor((width_ft+height_ft)*20+0.5)/10 AS perimeter_ft, replaced, printed AS by_print
FROM zone_results WHERE NOT replaced OR abs(width_ft*height_ft/((x2-x1)*(y2-y1)/100*(1+tag%2)) - 1) > 0.25""")
def _zones(t):
    found, _ = op.open_zones(*drawing(t))
    return found.select("page_id", "label_id", "label", "box.*", "width_ft", "height_ft", "area_sqft", "perimeter_ft", "replaced",
                        c("warning").startswith("Printed").alias("by_print"))


@query("open_zone_status", ("zone_results",), """
SELECT z.page_id, z.cell_id AS label_id, CASE WHEN r.label_id IS NOT NULL THEN 'measured' WHEN NOT b.reached THEN 'no_extent' WHEN b.n > 4 THEN 'too_many_members'
  ELSE 'implausible' END AS reason
FROM zoned z JOIN zone_boxes b ON z.page_id = b.page_id AND z.zone = b.zone LEFT JOIN zone_results r ON r.page_id = z.page_id AND r.label_id = z.cell_id WHERE NOT z.known""")
def _status(t):
    return op.open_zones(*drawing(t))[1]
