"""Benchmark matching and takeoff fusion queries."""

from pyspark.sql import functions as F

from plumbline.functions import pricing as P
from plumbline.operators import accuracy as op, fusion
from plumbline.plans.oracle import CTES
from plumbline.plans.quality import takeoff
from plumbline.plans.registry import query

c = F.col

CTES["truth"] = """
  SELECT project_id AS plan_id, CAST(plan_page_id AS BIGINT)*100 + coats*10 + CAST(confidence*10 AS INT) - 5 AS o, surface_id, room_label AS label, square_footage AS area
  FROM surfaces WHERE type='ceiling' AND room_label IS NOT NULL AND square_footage > 0 AND revision='old'"""
CTES["cand"] = CTES["truth"].replace("revision='old'", "revision='new'").replace("square_footage > 0 AND ", "")


def _side(t, revision):
    rows = t.surfaces.where((c("type") == "ceiling") & c("room_label").isNotNull() & (c("revision") == revision))
    if revision == "old":
        rows = rows.where(c("square_footage") > 0)
    return rows.select(c("project_id").alias("plan_id"), "surface_id", c("room_label").alias("label"),
                       c("square_footage").alias("area"),
                       F.conv(F.substring(F.sha2("surface_id", 256), 1, 12), 16, 10).cast("bigint").alias("ord"))


def truth(t):
    return _side(t, "old")


def cand(t):
    return _side(t, "new")


def _ord_sql(name):
    return f"('0x' || substr(sha256({name}), 1, 12))::BIGINT"


PLAIN = "trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'))"
TC = ("surfaces", "truth", "cand")


@query("match_greedy")
def _greedy(t):
    return op.match_greedy(truth(t), cand(t), width=1 << 44)


@query("match_fuzzy", TC, f"""
WITH t AS (SELECT plan_id, surface_id, {PLAIN} AS l FROM truth), d AS (SELECT plan_id, area, {PLAIN} AS l FROM cand),
tt AS (SELECT *, list_distinct(list_filter(string_split(l, ' '), lambda x: length(x) > 2)) AS tok FROM t),
dd AS (SELECT *, list_distinct(list_filter(string_split(l, ' '), lambda x: length(x) > 2)) AS tok FROM d)
SELECT t.surface_id, count(d.l) AS hits, sum(coalesce(d.area, 0)) FILTER (d.l IS NOT NULL) AS total FROM tt t LEFT JOIN dd d ON d.plan_id=t.plan_id AND
  (contains(d.l, t.l) OR contains(t.l, d.l) OR (len(t.tok) > 0 AND len(d.tok) > 0 AND len(list_intersect(t.tok, d.tok)) >= least(len(t.tok), len(d.tok)))) GROUP BY 1""")
def _fuzzy(t):
    return op.match_fuzzy(truth(t), cand(t)).select("surface_id", "hits", "total")


@query("match_keys", TC, """
SELECT t.surface_id, count(d.label) AS hits, sum(coalesce(d.area, 0)) FILTER (d.label IS NOT NULL) AS total FROM truth t LEFT JOIN cand d ON d.plan_id=t.plan_id AND
  (contains(lower(d.label), split_part(trim(lower(t.label)), ' ', 1)) OR contains(lower(d.label), 'rod')) GROUP BY 1""")
def _keys(t):
    keys = F.array(F.upper(F.substring_index(F.trim("label"), " ", 1)), F.lit("rod"))
    return op.match_keys(truth(t).withColumn("match_keys", keys), cand(t)).select("surface_id", "hits", "total")


@query("match_largest", TC, f"""
WITH t AS (SELECT *, {PLAIN} AS l FROM truth), d AS (SELECT *, {PLAIN} AS l FROM cand)
SELECT t.surface_id, count(d.l) AS hits, max(d.area) AS largest FROM t LEFT JOIN d ON d.plan_id=t.plan_id AND
  (contains(d.l, t.l) OR contains(t.l, split_part(d.l, ' ', 1))) GROUP BY 1""")
def _largest(t):
    return op.match_largest(truth(t), cand(t)).select("surface_id", "hits", "largest")


@query("accuracy_metrics", TC, f"""
WITH s AS (SELECT t.plan_id, t.area AS truth_area, d.area AS measured FROM (SELECT *, {PLAIN} AS l FROM truth) t
  LEFT JOIN (SELECT plan_id, {PLAIN} AS l, max(area) AS area FROM cand GROUP BY 1, 2) d ON d.plan_id=t.plan_id AND d.l=t.l),
e AS (SELECT *, abs(measured-truth_area)/truth_area*100 AS err FROM s)
SELECT plan_id, count(*) AS rooms, count(measured) AS matched, round(coalesce(avg(err), 0), 6) AS mae, count(*) FILTER (err <= 10) AS within_10,
  count(*) FILTER (err <= 20) AS within_20, sum(truth_area) AS truth_total, sum(coalesce(measured, 0)) AS measured_total,
  round(list_sort(list(err) FILTER (err IS NOT NULL))[CAST(floor(count(err)/2) AS BIGINT)+1], 6) AS median_err, round(count(measured)*100.0/count(*), 6) AS coverage_pct
FROM e GROUP BY 1""")
def _metrics(t):
    key = F.trim(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", " "))
    found = cand(t).groupBy("plan_id", key.alias("l")).agg(F.max("area").alias("measured"))
    scored = truth(t).withColumn("l", key).withColumnRenamed("area", "truth_area").join(found, ["plan_id", "l"], "left")
    return op.accuracy(scored, ["plan_id"]).select(
        "plan_id", "rooms", "matched", F.round("mae", 6).alias("mae"), "within_10", "within_20", "truth_total", "measured_total",
        F.round("median_err", 6).alias("median_err"), F.round("coverage_pct", 6).alias("coverage_pct"))


@query("best_measurement", ("surfaces",), """
SELECT project_id AS plan_id, room_label AS label, max(confidence) AS confidence, count(*) AS n FROM surfaces WHERE room_label IS NOT NULL GROUP BY 1, 2""")
def _best(t):
    rows = t.surfaces.where(c("room_label").isNotNull()).select(
        c("project_id").alias("plan_id"), c("room_label").alias("label"), "confidence", F.lit(1).alias("ord"), "type")
    counts = op.basis_counts(rows, "label")
    return op.best_by_label(rows).join(counts, ["plan_id", "label"]).select("plan_id", "label", "confidence", "n")


@query("rectangle_facts", ("cells",), """
SELECT cell_id, (x2-x1+y2-y1)*2 AS perimeter, (x2-x1+y2-y1)*2*9.0 AS wall_area, (x2-x1)*(y2-y1) AS floor_area, round(((x2-x1)-100)*100/100.0, 6) AS err FROM cells""")
def _facts(t):
    return t.cells.select("cell_id", op.rectangle_facts(c("x2") - c("x1"), c("y2") - c("y1"), F.lit(9.0)).alias("f"),
                          F.round(P.percent_error(c("x2") - c("x1"), F.lit(100.0)), 6).alias("err")).select("cell_id", "f.*", "err")


# --- fusion ------------------------------------------------------------------------------------
CTES["xrooms"] = """
  SELECT CAST(o_custkey AS VARCHAR) AS takeoff_id, o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'Cold' ELSE
    ['RED BOLT #2','old  gear','hot','new plate 7','blue'][CAST(o_orderkey % 5 AS INT)+1] END AS label,
    CASE WHEN o_orderkey % 7 > 0 THEN 100.0::DOUBLE + o_orderkey % 50 END AS area_sqft, CASE WHEN o_orderkey % 11 > 0 THEN 40.0::DOUBLE + o_orderkey % 30 END AS perimeter_ft,
    'scale-measured' AS derivation FROM orders"""


def xrooms(t):
    k = c("o_orderkey")
    label = F.when(k % 2 == 0, "Cold").otherwise(F.element_at(F.array(
        *[F.lit(v) for v in ("RED BOLT #2", "old  gear", "hot", "new plate 7", "blue")]), (k % 5 + 1).cast("int")))
    return t.raw("orders").select(
        c("o_custkey").cast("string").alias("takeoff_id"), k.alias("ord"), label.alias("label"),
        F.when(k % 7 > 0, F.lit(100.0) + k % 50).alias("area_sqft"), F.when(k % 11 > 0, F.lit(40.0) + k % 30).alias("perimeter_ft"),
        F.lit("scale-measured").alias("derivation"))


CTES["geo_q"] = """
  SELECT f.takeoff_id, f.ord, f.type, r.area_sqft AS ra, r.perimeter_ft AS rp, r.derivation AS rd, f.area_sqft, f.linear_ft, f.confidence, f.count FROM
  (SELECT *, regexp_replace(lower(room_label), '[^a-z0-9]+', '', 'g') AS k FROM takeoff) f LEFT JOIN (
  SELECT * FROM (SELECT a.takeoff_id, a.k, x.area_sqft, x.perimeter_ft, x.derivation, row_number() OVER (PARTITION BY a.takeoff_id, a.k
      ORDER BY CASE WHEN x.k=a.k THEN 0 ELSE 1 END, x.ord) AS rn FROM
    (SELECT DISTINCT takeoff_id, regexp_replace(lower(room_label), '[^a-z0-9]+', '', 'g') AS k FROM takeoff) a
    JOIN (SELECT *, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS k FROM xrooms) x ON x.takeoff_id=a.takeoff_id AND (x.k=a.k OR (length(x.k) >= 3
      AND (starts_with(a.k, x.k) OR starts_with(x.k, a.k))))) WHERE rn=1) r ON r.takeoff_id=f.takeoff_id AND r.k=f.k"""
GEO = ("surfaces", "takeoff", "xrooms", "geo_q")


@query("fuse_geometry", GEO, """
SELECT takeoff_id, ord, type, CASE type WHEN 'wall' THEN floor(rp*8.0*10+0.5)/10 WHEN 'ceiling' THEN ra ELSE area_sqft END AS area_sqft,
  CASE WHEN type IN ('wall', 'trim') THEN rp ELSE linear_ft END AS linear_ft, coalesce(rd, 'ai-fallback') AS derivation FROM geo_q""")
def _geometry(t):
    return fusion.fuse_geometry(takeoff(t), xrooms(t), F.lit(8.0)).select(
        "takeoff_id", "ord", "type", "area_sqft", "linear_ft", "derivation")


CTES["dimtable"] = """
  SELECT CAST(c_custkey AS VARCHAR) AS takeoff_id, n AS ord, ['cold bolt','Red  Gear','hot porch','new plate'][CAST(n AS INT)] AS label,
    10.0::DOUBLE + n + c_custkey % 3 AS width_ft, 8.0::DOUBLE + c_custkey % 4 AS height_ft FROM customer, range(1, 5) r(n) WHERE c_custkey % 2 = 0"""


def dimtable(t):
    n = c("n")
    return t.raw("customer").where(c("c_custkey") % 2 == 0).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4)))).select(
        c("c_custkey").cast("string").alias("takeoff_id"), n.alias("ord"),
        F.element_at(F.array(*[F.lit(v) for v in ("cold bolt", "Red  Gear", "hot porch", "new plate")]), n).alias("label"),
        (F.lit(10.0) + n + c("c_custkey") % 3).alias("width_ft"), (F.lit(8.0) + c("c_custkey") % 4).alias("height_ft"))


CTES["tabled"] = """
  SELECT takeoff_id, ord, type, area_sqft, linear_ft, count, substrate, confidence, room_label FROM takeoff WHERE takeoff_id NOT IN (SELECT takeoff_id FROM dimtable)
  UNION ALL SELECT takeoff_id, ord, type, area_sqft, linear_ft, count, substrate, confidence, room_label FROM takeoff f WHERE type NOT IN ('wall','ceiling') AND EXISTS (SELECT 1 FROM dimtable d
    WHERE d.takeoff_id=f.takeoff_id AND regexp_replace(lower(d.label), '[^a-z0-9]+', '', 'g')=regexp_replace(lower(f.room_label), '[^a-z0-9]+', '', 'g'))
  UNION ALL SELECT d.takeoff_id, CAST(d.ord AS VARCHAR), d.type, CASE d.type WHEN 'wall' THEN floor((width_ft+height_ft)*2*9*10+0.5)/10 ELSE floor(width_ft*height_ft*10+0.5)/10 END,
    CASE d.type WHEN 'wall' THEN floor((width_ft+height_ft)*2*10+0.5)/10 END, NULL, CASE WHEN a.k IS NULL THEN 'drywall' ELSE coalesce(a.ai.substrate, 'drywall') END,
    coalesce(a.ai.confidence, 0.85), d.label
  FROM (SELECT *, unnest(['wall','ceiling']) AS type, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS k FROM dimtable WHERE label <> 'hot porch') d
  LEFT JOIN (SELECT takeoff_id, type, regexp_replace(lower(room_label), '[^a-z0-9]+', '', 'g') AS k, arg_max({'substrate': substrate, 'confidence': confidence}, ord) AS ai FROM takeoff
    WHERE type IN ('wall','ceiling') GROUP BY 1, 2, 3) a ON a.takeoff_id=d.takeoff_id AND a.type=d.type AND a.k=d.k"""
TAB = ("surfaces", "takeoff", "dimtable", "tabled")


@query("fuse_dimension_table", TAB, "SELECT takeoff_id, ord, type, area_sqft, linear_ft, substrate, confidence FROM tabled")
def _table(t):
    return fusion.fuse_dimension_table(takeoff(t), dimtable(t)).select(
        "takeoff_id", "ord", "type", "area_sqft", "linear_ft", "substrate", "confidence")


CTES["findings"] = """
  SELECT CAST(c_custkey AS VARCHAR) AS takeoff_id, n AS pos, ['wall','door','ceiling','missing_room','wall'][CAST(n AS INT)] AS kind, ['Bolt','r','cold','x','BOLT'][CAST(n AS INT)] AS room_label,
    CASE WHEN (c_custkey+n) % 2 = 0 THEN 'high' ELSE 'low' END AS severity, CASE WHEN n <> 5 OR c_custkey % 3 > 0 THEN 50.0::DOUBLE + n END AS suggested_area, 3 AS suggested_count
  FROM customer, range(1, 6) r(n)"""


def findings(t):
    n = c("n")
    at = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), n)
    return t.raw("customer").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(5)))).select(
        c("c_custkey").cast("string").alias("takeoff_id"), n.alias("pos"), at("wall", "door", "ceiling", "missing_room", "wall").alias("kind"),
        at("Bolt", "r", "cold", "x", "BOLT").alias("room_label"),
        F.when((c("c_custkey") + n) % 2 == 0, "high").otherwise("low").alias("severity"),
        F.when((n != 5) | (c("c_custkey") % 3 > 0), F.lit(50.0) + n).alias("suggested_area"), F.lit(3).alias("suggested_count"))


CTES["effects"] = """
  SELECT takeoff_id, type, ord, arg_max(suggested_area, pos) FILTER (severity='high' AND suggested_area > 0) AS area, arg_max(suggested_count, pos) FILTER (severity='high') AS cnt FROM (
  SELECT f.takeoff_id, f.kind AS type, f.pos, f.severity, f.suggested_area, f.suggested_count, min(t.ord) AS ord FROM findings f JOIN takeoff t ON t.takeoff_id=f.takeoff_id AND t.type=f.kind
    AND contains(lower(t.room_label), lower(f.room_label)) GROUP BY ALL) GROUP BY 1, 2, 3"""


@query("apply_findings", ("surfaces", "takeoff", "findings", "effects"), """
SELECT t.takeoff_id, t.ord, CASE WHEN e.ord IS NOT NULL THEN least(confidence, 0.5) ELSE confidence END AS confidence,
  CASE WHEN t.type IN ('wall','ceiling') THEN coalesce(e.area, area_sqft) ELSE area_sqft END AS area_sqft,
  CASE WHEN t.type IN ('door','window') THEN coalesce(e.cnt, count) ELSE count END AS count
FROM takeoff t LEFT JOIN effects e ON e.takeoff_id=t.takeoff_id AND e.type=t.type AND e.ord=t.ord""")
def _findings(t):
    return fusion.apply_findings(takeoff(t), findings(t)).select("takeoff_id", "ord", "confidence", "area_sqft", "count")


@query("fuse_takeoff")
def _fuse(t):
    return fusion.fuse(takeoff(t), dimtable(t), findings(t), xrooms(t), F.lit(8.0)).select(
        "takeoff_id", "ord", "type", "area_sqft", "linear_ft", "count", "confidence", "derivation")
