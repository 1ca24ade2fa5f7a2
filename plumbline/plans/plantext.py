"""Plan text queries; the oracles use the known construction of the fragments, not the same patterns."""

from pyspark.sql import functions as F

from plumbline.functions import plantext as X
from plumbline.operators import plantext as op
from plumbline.plans.oracle import CTES
from plumbline.plans.registry import query

c = F.col
FR = ("fragments",)

CTES["kinds"] = """
  SELECT CAST(CAST(floor(p_partkey/40) AS BIGINT) AS VARCHAR) AS page_id, CAST(p_partkey % 40 AS INT) AS seq, p_partkey % 10 AS k, p_partkey % 12 AS i,
    p_size AS s, p_partkey AS pk, p_name FROM part"""


@query("callouts", ("kinds",), """
SELECT page_id, seq, round(length_ft, 9) AS length_ft, confidence, CASE s % 4 WHEN 1 THEN 'v' ELSE 'h' END AS orientation FROM (
SELECT page_id, seq, s, s + i/12.0::DOUBLE AS length_ft, 0.99::DOUBLE AS confidence FROM kinds WHERE k=1
UNION ALL SELECT page_id, seq, s, s + (i+0.5)/12.0::DOUBLE, 0.99 FROM kinds WHERE k=6
UNION ALL SELECT page_id, seq, s, s::DOUBLE, 0.95 FROM kinds WHERE k=8 AND s > 0
UNION ALL SELECT page_id, seq, s, (s%40)/12.0::DOUBLE, 0.7 FROM kinds WHERE k=5 AND s%40 > 0 AND s%40 < 36)""")
def _callouts(t):
    return op.callouts(t.fragments).select("page_id", "seq", F.round("length_ft", 9).alias("length_ft"), "confidence",
                                           "orientation")


@query("parse_dims", ("kinds",), """
SELECT page_id, seq, round(s + i/12.0, 9)::DOUBLE AS width_ft, round(s%17+4 + ((i+5)%12)/12.0, 9)::DOUBLE AS height_ft FROM kinds WHERE k=2 AND s + i > 0""")
def _dims(t):
    return t.fragments.select("page_id", "seq", X.parse_dim(c("text")).alias("d")).where("d is not null").select(
        "page_id", "seq", F.round("d.width_ft", 9).alias("width_ft"), F.round("d.height_ft", 9).alias("height_ft"))


CTES["scales"] = """
  SELECT page_id, seq, pk % 3 AS v, CASE pk % 3 WHEN 0 THEN 18.0 WHEN 1 THEN 9.0 ELSE 8.636 END::DOUBLE AS pt,
    CASE pk % 3 WHEN 0 THEN '1/4" = 1''-0"' WHEN 1 THEN '1/8" = 1''-0"' ELSE '1:100' END AS label,
    CASE pk % 3 WHEN 2 THEN 'metric' ELSE 'imperial' END AS kind, CASE pk % 3 WHEN 2 THEN 0.6 ELSE 0.75 END::DOUBLE AS conf
  FROM kinds WHERE k=4 AND seq < 20"""
CTES["anchors"] = """
  SELECT * FROM (SELECT page_id, seq, pt, label, kind, conf FROM scales
  UNION ALL SELECT a.page_id, a.seq, b.pt, b.label, b.kind, b.conf+0.1::DOUBLE FROM kinds a JOIN scales b ON b.page_id=a.page_id AND b.seq=a.seq+1
    WHERE a.k=3 AND a.seq < 20) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY conf DESC, seq) = 1"""


@query("scale_anchor", ("kinds", "scales", "anchors"), """
SELECT page_id, seq, round(pt, 6) AS pt_per_foot, label, kind, round(conf, 6) AS confidence FROM anchors""")
def _anchor(t):
    return op.scale_anchor(t.fragments).select("page_id", "seq", F.round("pt_per_foot", 6).alias("pt_per_foot"), "label",
                                               "kind", F.round("confidence", 6).alias("confidence"))


CTES["bars"] = """
  SELECT CAST(s_suppkey AS VARCHAR) AS page_id, CAST(n AS INT) AS seq, CAST(n*4 AS VARCHAR) || CASE WHEN s_suppkey % 2 = 0 THEN '''' ELSE ' ft' END AS text,
    100.0::DOUBLE + n*4*(5+s_suppkey%7) + CASE WHEN s_suppkey % 9 = 0 AND n = 2 THEN 30 ELSE 0 END AS x, 50.0::DOUBLE + n%2*3 AS y
  FROM supplier, range(0, 5) r(n)"""


def bars(t):
    n = c("n")
    return t.raw("supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n")).select(
        c("s_suppkey").cast("string").alias("page_id"), n.alias("seq"),
        F.concat((n * 4).cast("string"), F.when(c("s_suppkey") % 2 == 0, "'").otherwise(" ft")).alias("text"),
        (F.lit(100.0) + n * 4 * (c("s_suppkey") % 7 + 5) + F.when((c("s_suppkey") % 9 == 0) & (n == 2), 30).otherwise(0)).alias("x"),
        (F.lit(50.0) + (n % 2) * 3).alias("y"))


@query("scale_bar", (), """
SELECT CAST(s_suppkey AS VARCHAR) AS page_id, (5+s_suppkey%7)::DOUBLE AS pt_per_foot, 'Scale bar: 0–16 ft' AS label, 0.9499::DOUBLE AS confidence,
  'horizontal' AS orientation FROM supplier WHERE s_suppkey % 9 <> 0""")
def _bar(t):
    return op.scale_bar(bars(t)).withColumn("confidence", F.round("confidence", 6))


CTES["doors"] = """
  SELECT CAST(o_orderkey % 97 AS VARCHAR) AS page_id, 20.0::DOUBLE + o_custkey % 13 AS size FROM orders"""


def doors(t):
    return t.raw("orders").select((c("o_orderkey") % 97).cast("string").alias("page_id"),
                                  (F.lit(20.0) + c("o_custkey") % 13).alias("size"))


CTES["verified"] = """
  SELECT s.page_id, pt_per_foot, coalesce(n, 0) AS doors, med/pt_per_foot AS implied_ft, CASE WHEN coalesce(n, 0) < 3 THEN 'insufficient_data'
    WHEN med/pt_per_foot/3 BETWEEN 0.85 AND 1.15 THEN 'verified' WHEN med/pt_per_foot/3 BETWEEN 0.7 AND 1.4 THEN 'weak' ELSE 'mismatch' END AS check
  FROM (SELECT page_id, pt AS pt_per_foot FROM anchors) s LEFT JOIN (SELECT page_id, count(*) AS n,
    list_sort(list(size))[CAST(floor(count(*)*0.1) + floor((count(*)-2*floor(count(*)*0.1))/2) AS BIGINT)+1] AS med FROM doors GROUP BY 1) d USING (page_id)"""
VER = ("kinds", "scales", "anchors", "doors", "verified")


@query("verify_scale", VER, 'SELECT page_id, doors, round(CASE WHEN doors >= 3 THEN implied_ft END, 6) AS implied_ft, "check" FROM verified')
def _verify(t):
    return op.verify_scale(doors(t), op.scale_anchor(t.fragments).select("page_id", "pt_per_foot")).select(
        "page_id", "doors", F.round("implied_ft", 6).alias("implied_ft"), "check")


@query("establish_scale", VER, """
SELECT a.page_id, CASE WHEN CAST(a.page_id AS BIGINT) % 5 = 0 THEN 12.0 ELSE a.pt END AS pt_per_foot,
  CASE WHEN CAST(a.page_id AS BIGINT) % 5 = 0 THEN 'user' ELSE 'text-notation' END AS method,
  round(CASE WHEN CAST(a.page_id AS BIGINT) % 5 = 0 THEN 0.99 WHEN "check"='verified' THEN least(0.99, conf+0.05)
    WHEN "check"='mismatch' THEN greatest(0.2, conf-0.4) ELSE conf END, 6) AS confidence FROM anchors a JOIN verified v ON v.page_id=a.page_id""")
def _establish(t):
    user = t.fragments.where((c("page_id").cast("bigint") % 5 == 0) & (c("seq") == 0)).select(
        "page_id", F.lit(12.0).alias("pt_per_foot"), F.lit("mine").alias("label"))
    return op.establish_scale(t.fragments, doors(t), user).select(
        "page_id", "pt_per_foot", "method", F.round("confidence", 6).alias("confidence"))


@query("two_point_scale", ("cells",), """
SELECT cell_id, round(sqrt(power((x2-x1)/1224*1224, 2)+power((y2-y1)/792*792, 2))/10, 6) AS pt_per_foot FROM cells""")
def _two(t):
    w, h = F.lit(1224.0), F.lit(792.0)
    return t.cells.select("cell_id", F.round(X.two_point_scale(
        c("x1") / w, c("y1") / h, c("x2") / w, c("y2") / h, w, h, F.lit(10.0)), 6).alias("pt_per_foot"))


@query("scale_accepted", ("kinds", "scales", "anchors"), """
SELECT page_id, conf-0.2 >= 0.45 AS accepted, conf-0.2 >= 0.45 AND conf-0.2 < 0.6 AS warn FROM anchors""")
def _accepted(t):
    return op.scale_anchor(t.fragments).select("page_id", X.scale_accepted(
        F.lit("text-notation"), c("confidence") - 0.2).alias("v")).select("page_id", "v.*")


# labels: rooms are the k=0 fragments, built as NAME WORD
@query("table_room_labels", ("fragments",), """
SELECT page_id, seq, text FROM fragments WHERE seq % 10 = 0 AND length(text) <= 40""")
def _table_rooms(t):
    return t.fragments.where(X.is_table_room(c("text"))).select("page_id", "seq", "text")


@query("candidate_room_labels", ("fragments",), """
SELECT page_id, seq, text FROM fragments WHERE seq % 10 = 0 AND length(text) <= 40""")
def _candidate_rooms(t):
    return t.fragments.where(X.is_candidate_room(c("text"))).select("page_id", "seq", "text")


@query("header_fragments", ("fragments",), """
SELECT page_id, seq FROM fragments WHERE upper(trim(text)) = 'SCALE' OR regexp_matches(text, '^[0-9][0-9.,]*$')""")
def _headers(t):
    return t.fragments.where(X.is_header(c("text"))).select("page_id", "seq")


@query("margin_fragments", ("fragments",), """
SELECT page_id, seq FROM fragments WHERE (x+width/2)/page_w < 0.06 OR (x+width/2)/page_w > 0.98 OR (y+height/2)/page_h < 0.02 OR (y+height/2)/page_h > 0.98""")
def _margin(t):
    shifted = t.fragments.withColumn("x", c("x") - F.lit(0.04) * c("page_w"))
    return shifted.where(X.in_margin(*[c(n) for n in ("x", "y", "width", "height", "page_w", "page_h")])
                         | (((c("x") + c("width") / 2) / c("page_w") + 0.04) > 0.98)).select("page_id", "seq")


CTES["strips"] = """
  SELECT page_id, r >= ceil(n*0.4) AS right_strip, b >= ceil(n*0.4) AS bottom_strip FROM (
  SELECT page_id, count(*) AS n, count(*) FILTER (x/page_w > 0.7) AS r, count(*) FILTER (1-y/page_h > 0.78) AS b FROM fragments
  WHERE text = 'REVISIONS' GROUP BY 1) WHERE n >= 2"""


@query("title_strips", ("fragments", "strips"), "SELECT * FROM strips")
def _strips(t):
    return op.title_strips(t.fragments)


@query("pick_labels", ("fragments", "strips"), """
SELECT f.page_id, f.seq FROM fragments f LEFT JOIN strips s USING (page_id) WHERE (seq % 10 IN (0, 9) OR (seq % 10 IN (3, 4) AND seq >= 20) OR text='DRAWN BY')
  AND length(text) BETWEEN 2 AND 40 AND 1-y/page_h BETWEEN 0.04 AND 0.97 AND x/page_w BETWEEN 0.02 AND 0.98
  AND NOT (coalesce(right_strip, false) AND x/page_w >= 0.7) AND NOT (coalesce(bottom_strip, false) AND 1-y/page_h >= 0.78)""")
def _pick(t):
    return op.pick_labels(t.fragments).select("page_id", "seq")


CTES["dimrows"] = """
  SELECT d.page_id, d.seq, d.w, d.h, g.text AS label, g.seq AS label_seq FROM (
    SELECT f.page_id, f.seq, f.x, f.y, s + i/12.0::DOUBLE AS w, s%17+4 + ((i+5)%12)/12.0::DOUBLE AS h FROM fragments f JOIN kinds USING (page_id, seq) WHERE k=2 AND s+i > 0) d
  JOIN fragments g ON g.page_id=d.page_id AND abs(g.y-d.y) <= 5 AND g.x < d.x AND d.x-(g.x+g.width) >= 0
  WHERE g.seq % 10 <> 2 AND upper(trim(g.text)) <> 'SCALE' AND NOT regexp_matches(g.text, '^[0-9][0-9.,]*$')
  QUALIFY row_number() OVER (PARTITION BY d.page_id, d.seq ORDER BY d.x-(g.x+g.width), g.seq) = 1"""


@query("dim_rows", ("fragments", "kinds", "dimrows"), """
SELECT page_id, seq, label, label_seq, round(w, 9) AS width_ft, round(h, 9) AS height_ft FROM dimrows
QUALIFY row_number() OVER (PARTITION BY page_id, lower(label) ORDER BY seq) = 1""")
def _dim_rows(t):
    return op.dim_rows(t.fragments).select("page_id", "seq", "label", "label_seq", F.round("width_ft", 9).alias("width_ft"),
                                           F.round("height_ft", 9).alias("height_ft"))


@query("dim_table_box", ("fragments", "kinds"), """
WITH h AS (SELECT f.* REPLACE (page_id || '/' || (seq // 20) AS page_id), seq % 10 = 2 AND coalesce(k=2 AND s+i > 0, false) AS dim FROM fragments f LEFT JOIN kinds USING (page_id, seq)),
d AS (SELECT * FROM h WHERE dim),
b AS (SELECT page_id, min(x) AS x0, max(x+width) AS x1, min(y) AS y0, max(y+height) AS y1 FROM d GROUP BY 1
  HAVING count(*) >= 2 AND (max(x+width)-min(x))*(max(y+height)-min(y)) <= max(page_w*page_h)*0.12),
l AS (SELECT b.page_id, min(f.x) AS lx, min(f.y) AS ly, max(f.y+f.height) AS lt FROM b JOIN h f USING (page_id)
  WHERE NOT dim AND f.x+f.width > b.x0 AND f.x < b.x1 AND EXISTS (SELECT 1 FROM d WHERE d.page_id=f.page_id AND abs(d.y-f.y) <= 3) GROUP BY 1)
SELECT page_id, least(x0, lx)-4 AS x0, least(y0, ly)-4 AS y0, x1+4 AS x1, greatest(y1, lt)+4 AS y1 FROM b LEFT JOIN l USING (page_id)""")
def _box(t):
    """Every fragment, on sheets of half a page each: whole pages are too large for a schedule."""
    half = F.concat_ws("/", "page_id", F.floor(c("seq") / 20).cast("string"))
    return op.dim_table_box(t.fragments.withColumn("page_id", half))


@query("sizing_hint", ("fragments", "kinds", "dimrows"), """
SELECT page_id, round(sqrt(1224.0*792.0*0.7*0.6/sum(w*h)), 6) AS pt_per_foot FROM (SELECT * FROM dimrows
QUALIFY row_number() OVER (PARTITION BY page_id, lower(label) ORDER BY seq) = 1) GROUP BY 1""")
def _sizing(t):
    areas = t.fragments.groupBy("page_id").agg(F.max(c("page_w") * c("page_h") * 0.7).alias("plan_area"))
    return op.sizing_hint(op.dim_rows(t.fragments), areas).withColumn("pt_per_foot", F.round("pt_per_foot", 6))


@query("page_skips", ("fragments",), """
SELECT CAST(g AS VARCHAR) AS page_id, CASE WHEN n < 3 AND g % 2 = 0 THEN 'no_text_layer' WHEN rooms = 0 THEN 'non_floor_plan' END AS skip FROM (
SELECT CAST(page_id AS BIGINT)*40+seq-seq%2 AS g, count(*) AS n, count(*) FILTER (seq % 10 = 0 AND length(text) <= 40) AS rooms FROM fragments GROUP BY 1)""")
def _skips(t):
    page = c("page_id").cast("bigint") * 40 + c("seq") - c("seq") % 2
    small = t.fragments.withColumn("page_id", page.cast("string"))
    ops = small.select("page_id").distinct().withColumn("ops", F.lit(10))
    return op.page_skips(small, ops)


@query("min_room_sqft", ("fragments",), """
SELECT page_id, seq, CASE split_part(text, ' ', 3) WHEN 'OFFICE' THEN 60 WHEN 'BEDROOM' THEN 60 WHEN 'KITCHEN' THEN 60 WHEN 'CORRIDOR' THEN 15
  WHEN 'LOBBY' THEN 80 WHEN 'BATH' THEN 15 WHEN 'CLOSET' THEN 15 ELSE 0 END AS sqft FROM fragments""")
def _min_sqft(t):
    return t.fragments.select("page_id", "seq", X.min_room_sqft(c("text")).alias("sqft"))


@query("interior_rooms", ("surfaces",), """
SELECT surface_id FROM surfaces WHERE room_label IS NOT NULL AND NOT (coats=1 AND type='wall')""")
def _interior(t):
    label = F.when((c("coats") == 1) & (c("type") == "wall"), F.concat(c("room_label"), F.lit(" Deck"))).otherwise(
        F.concat(c("room_label"), F.lit(" decking")))
    return t.surfaces.where(X.is_interior(label)).select("surface_id")
