"""Bid queries."""

from pyspark.sql import functions as F

from plumbline import refdata as R
from plumbline.functions import pricing as P
from plumbline.operators import pricing as op
from plumbline.plans.oracle import CTES, case
from plumbline.plans.registry import query, steady, steady_sql

c = F.col

_coverage = ("CASE WHEN s.substrate IS NULL OR s.substrate='' THEN 350.0::DOUBLE "
             + " ".join(f"WHEN contains(lower(s.substrate), '{w}') THEN 350.0::DOUBLE/{m}::DOUBLE"
                        for w, m in R.SUBSTRATE_COVERAGE) + " ELSE 350.0::DOUBLE END")

CTES["lines"] = f"""
  SELECT q.*, CASE WHEN production_rate > 0 THEN quantity*coats/production_rate ELSE 0.0 END AS labor_hours,
    (CASE WHEN production_rate > 0 THEN quantity*coats/production_rate ELSE 0.0 END)*hourly*1.3::DOUBLE AS labor_cost,
    (CASE unit WHEN 'sqft' THEN quantity*coats/coverage WHEN 'lf' THEN quantity*coats/250.0::DOUBLE
       ELSE quantity*coats*0.25::DOUBLE END)*(1.0::DOUBLE+waste_factor) AS gallons,
    (CASE unit WHEN 'sqft' THEN quantity*coats/coverage WHEN 'lf' THEN quantity*coats/250.0::DOUBLE
       ELSE quantity*coats*0.25::DOUBLE END)*(1.0::DOUBLE+waste_factor)*45.0::DOUBLE AS material_cost
  FROM (SELECT s.project_id, s.surface_id, s.type, s.room_label, s.paint_type, s.coats, waste_factor,
      CASE s.type WHEN 'trim' THEN 'lf' WHEN 'door' THEN 'ea' WHEN 'window' THEN 'ea' ELSE 'sqft' END AS unit,
      CASE s.type WHEN 'trim' THEN coalesce(s.linear_footage, 0) WHEN 'door' THEN coalesce(s.count, 1)
        WHEN 'window' THEN coalesce(s.count, 1) ELSE coalesce(s.square_footage, 0)
          * {case('p.measurement_mode', {k: f'{v}::DOUBLE' for k, v in R.MODE_FACTOR.items()}, '1.0')} END::DOUBLE AS quantity,
      {case('s.type', {k: f'{v}::DOUBLE' for k, v in R.PRODUCTION_RATES.items()}, 'NULL')} AS production_rate,
      coalesce(h.hourly, (SELECT coalesce(arg_min(rate, ord), 55.0) FROM rates WHERE surface_type='default')) AS hourly,
      {_coverage} AS coverage, s.square_footage, s.linear_footage, s.count
    FROM surfaces s JOIN projects p USING (project_id)
    LEFT JOIN (SELECT surface_type, arg_max(hourly_cost, ord) AS hourly FROM rates WHERE hourly_cost IS NOT NULL
               GROUP BY 1) h ON h.surface_type = s.type
    WHERE s.status <> 'excluded' AND NOT starts_with(s.type, 'annotation:') AND NOT starts_with(s.type, 'symbol:')
      AND (s.type <> 'wall-path' OR coalesce(s.finish_type, 'paint') = 'paint')) q"""

CTES["totals"] = """
  SELECT project_id, total_labor, total_material, line_count, subtotal, subtotal*overhead_pct AS total_overhead,
    (subtotal+subtotal*overhead_pct)*markup AS total_markup,
    subtotal+subtotal*overhead_pct+(subtotal+subtotal*overhead_pct)*markup AS grand_total
  FROM (SELECT p.project_id, p.overhead_pct, p.markup, coalesce(sum(labor_cost), 0) AS total_labor,
      coalesce(sum(material_cost), 0) AS total_material, count(l.project_id) AS line_count,
      coalesce(sum(labor_cost), 0)+coalesce(sum(material_cost), 0) AS subtotal
    FROM projects p LEFT JOIN lines l ON l.project_id=p.project_id GROUP BY 1, 2, 3)"""
LINES = ("lines",)
TOTALS = ("lines", "totals")


def lines(t):
    return op.bid_lines(t.surfaces, t.projects, t.rates)


def totals(t):
    return op.bid_totals(lines(t), t.projects)


def money(*names):
    return [steady(n).alias(n) for n in names]


MONEY = ("total_labor", "total_material", "subtotal", "total_overhead", "total_markup", "grand_total")
MONEY_SQL = ", ".join(f"{steady_sql(n)} AS {n}" for n in MONEY)


@query("bid_line_items", LINES, """
SELECT project_id, surface_id, type, room_label, paint_type, coats, unit, round(quantity, 6) AS quantity,
  round(production_rate, 6) AS production_rate, round(labor_hours, 6) AS labor_hours,
  round(labor_cost, 6) AS labor_cost, round(gallons, 6) AS gallons, round(material_cost, 6) AS material_cost FROM lines""")
def _bid_line_items(t):
    return lines(t).drop("needs_measurement").select(
        "project_id", "surface_id", "type", "room_label", "paint_type", "coats", "unit",
        *[F.round(c(n), 6).alias(n) for n in ("quantity", "production_rate", "labor_hours", "labor_cost",
                                              "gallons", "material_cost")])


@query("bid_totals", TOTALS, f"SELECT project_id, line_count, {MONEY_SQL} FROM totals")
def _bid_totals(t):
    return totals(t).select("project_id", "line_count", *money(*MONEY))


@query("room_schedule", LINES, f"""
SELECT project_id, coalesce(room_label, '(no room)') AS room_label,
  round(sum(CASE WHEN type='wall' THEN quantity ELSE 0 END), 4) AS wall_sqft, 0.0::DOUBLE AS wall_lf,
  round(sum(CASE WHEN type='ceiling' THEN quantity ELSE 0 END), 4) AS ceiling_sqft,
  sum(CASE WHEN type='trim' THEN quantity ELSE 0 END) AS trim_lf,
  sum(CASE WHEN type='door' THEN quantity ELSE 0 END) AS doors,
  sum(CASE WHEN type='window' THEN quantity ELSE 0 END) AS windows,
  {steady_sql('sum(labor_cost)')} AS labor_cost, {steady_sql('sum(material_cost)')} AS material_cost,
  {steady_sql('sum(labor_cost)+sum(material_cost)')} AS total_cost FROM lines GROUP BY 1, 2""")
def _room_schedule(t):
    return op.room_schedule(lines(t)).select(
        "project_id", "room_label", F.round("wall_sqft", 4).alias("wall_sqft"), "wall_lf",
        F.round("ceiling_sqft", 4).alias("ceiling_sqft"), "trim_lf", "doors", "windows",
        *money("labor_cost", "material_cost", "total_cost"))


@query("needs_measurement", LINES, """
SELECT project_id, surface_id, type, unit FROM lines WHERE quantity = 0 AND
  CASE unit WHEN 'sqft' THEN square_footage WHEN 'lf' THEN linear_footage ELSE count::DOUBLE END IS NULL""")
def _needs_measurement(t):
    return lines(t).where("needs_measurement").select("project_id", "surface_id", "type", "unit")


@query("latest_bid", ("bid_versions",), """
SELECT project_id, version_number, grand_total FROM bid_versions
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY version_number DESC) = 1""")
def _latest_bid(t):
    return op.latest_bid(t.bid_versions)


@query("next_version", TOTALS + ("bid_versions",), f"""
SELECT t.project_id, CAST(coalesce(v.last, 0)+1 AS INT) AS version_number, {steady_sql('t.grand_total')} AS grand_total
FROM totals t LEFT JOIN (SELECT project_id, max(version_number) AS last FROM bid_versions GROUP BY 1) v USING (project_id)""")
def _next_version(t):
    return op.append_bid(t.bid_versions, totals(t)).select("project_id", "version_number", *money("grand_total"))


@query("bid_csv", TOTALS, """
SELECT project_id, part, ord, room, kind, coats, qty, round(round(labor, 2)) AS labor, round(round(material, 2)) AS material FROM (
SELECT project_id, 0 AS part, '' AS ord, 'Room' AS room, 'Type' AS kind, 'Coats' AS coats, 'Quantity' AS qty,
  NULL::DOUBLE AS labor, NULL::DOUBLE AS material FROM totals
UNION ALL SELECT project_id, 1, surface_id, coalesce(room_label, ''), type, CAST(coats AS VARCHAR),
  CAST(CAST(floor(quantity+0.5) AS BIGINT) AS VARCHAR), labor_cost, material_cost FROM lines
UNION ALL SELECT project_id, 2, '', '', '', '', '', NULL, NULL FROM totals
UNION ALL SELECT project_id, 3, '', 'Subtotal', '', '', '', total_labor, total_material FROM totals
UNION ALL SELECT project_id, 4, '', 'Overhead', '', '', '', total_overhead, NULL FROM totals
UNION ALL SELECT project_id, 5, '', 'Markup', '', '', '', total_markup, NULL FROM totals
UNION ALL SELECT project_id, 6, '', 'Grand total', '', '', '', grand_total, NULL FROM totals)""")
def _bid_csv(t):
    return op.bid_csv(lines(t), totals(t)).select(
        "project_id", "part", "ord", c("c0").alias("room"), c("c1").alias("kind"), c("c3").alias("coats"),
        c("c4").alias("qty"), F.round(F.expr("try_cast(c9 as double)")).alias("labor"),
        F.round(F.expr("try_cast(c8 as double)")).alias("material"))


@query("workbook_summary", TOTALS + ("bid_versions",), """
WITH b AS (SELECT t.*, p.name, p.client_name, p.measurement_mode, p.waste_factor, p.overhead_pct, p.markup,
  v.version_number FROM totals t JOIN projects p USING (project_id)
  JOIN (SELECT project_id, max(version_number) AS version_number FROM bid_versions GROUP BY 1) v USING (project_id))
SELECT project_id, ord, field, value FROM (
SELECT project_id, 1 AS ord, 'Project' AS field, name AS value FROM b
UNION ALL SELECT project_id, 2, 'Client', coalesce(client_name, '') FROM b
UNION ALL SELECT project_id, 3, 'Bid version', CAST(version_number AS VARCHAR) FROM b
UNION ALL SELECT project_id, 4, 'Generated', '2024-01-31' FROM b
UNION ALL SELECT project_id, 5, '', '' FROM b UNION ALL SELECT project_id, 11, '', '' FROM b
UNION ALL SELECT project_id, 12, 'Measurement mode', measurement_mode FROM b)""")
def _workbook_summary(t):
    sheet = op.bid_summary(totals(t), t.projects, op.latest_bid(t.bid_versions), "2024-01-31")
    return sheet.where(~c("ord").between(6, 10) & (c("ord") < 13))


@query("workbook_amounts", TOTALS + ("bid_versions",), """
WITH b AS (SELECT t.*, p.waste_factor, p.overhead_pct, p.markup FROM totals t JOIN projects p USING (project_id)
  WHERE project_id IN (SELECT project_id FROM bid_versions))
SELECT project_id, ord, field, round(round(value, 2)) AS value FROM (
SELECT project_id, 6 AS ord, 'Total material' AS field, total_material AS value FROM b
UNION ALL SELECT project_id, 7, 'Total labor', total_labor FROM b
UNION ALL SELECT project_id, 8, 'Total overhead', total_overhead FROM b
UNION ALL SELECT project_id, 9, 'Total markup', total_markup FROM b
UNION ALL SELECT project_id, 10, 'Grand total', grand_total FROM b
UNION ALL SELECT project_id, 13, 'Waste factor', waste_factor*100 FROM b
UNION ALL SELECT project_id, 14, 'Overhead', overhead_pct*100 FROM b
UNION ALL SELECT project_id, 15, 'Markup', markup*100 FROM b)""")
def _workbook_amounts(t):
    sheet = op.bid_summary(totals(t), t.projects, op.latest_bid(t.bid_versions), "2024-01-31")
    return sheet.where(c("ord").between(6, 10) | (c("ord") >= 13)).select(
        "project_id", "ord", "field", F.round(c("value").cast("double") * F.when(c("ord") >= 13, 100.0).otherwise(1.0)).alias("value"))


@query("workbook_lines", LINES, """
SELECT project_id, surface_id, coalesce(room_label, '') AS room, type, coalesce(paint_type, '') AS paint, coats, unit,
  round(gallons, 6) AS gallons FROM lines""")
def _workbook_lines(t):
    return op.line_sheet(lines(t)).select("project_id", "surface_id", "room", "type", "paint", "coats", "unit",
                                          F.round("gallons", 6).alias("gallons"))


@query("workbook_symbols", ("surfaces",), """
SELECT project_id, surface_id, regexp_replace(type, '^symbol:', '') AS type, coalesce(room_label, '') AS room,
  coalesce(count, 0) AS count, confidence FROM surfaces WHERE starts_with(type, 'symbol:')""")
def _workbook_symbols(t):
    return op.symbol_sheet(t.surfaces)


@query("reprice", ("surfaces", "projects", "rates"), f"""
WITH edited AS (SELECT s.* REPLACE (
    CASE WHEN coats=3 AND type IN ('wall','ceiling','wall-path') THEN 100.0/{case('p.measurement_mode', {k: f'{v}::DOUBLE' for k, v in R.MODE_FACTOR.items()}, '1.0')}
      ELSE square_footage END AS square_footage,
    CASE WHEN coats=3 AND type='trim' THEN 100.0 ELSE linear_footage END AS linear_footage,
    CASE WHEN coats=3 AND type IN ('door','window') THEN 100 ELSE count END AS count)
  FROM surfaces s JOIN projects p USING (project_id)),
lines AS ({CTES['lines'].replace('FROM surfaces s', 'FROM edited s')}),
totals AS ({CTES['totals']})
SELECT project_id, {MONEY_SQL} FROM totals""")
def _reprice(t):
    over = t.surfaces.where((c("coats") == 3) & c("type").isin(R.SURFACE_TYPES)).select(
        "surface_id", F.lit(100.0).alias("quantity")).distinct()
    return op.reprice(t.surfaces, t.projects, t.rates, over).select("project_id", *money(*MONEY))


@query("complexity_rates", ("surfaces",), """
SELECT surface_id, CASE type WHEN 'trim' THEN 'lf' WHEN 'door' THEN 'ea' WHEN 'window' THEN 'ea' ELSE 'sqft' END AS unit,
  round((""" + case("type", {k: f"{v}::DOUBLE" for k, v in R.PRODUCTION_RATES.items()}, "NULL") + """)/2.25, 6) AS rate,
  round(floor(confidence*10+0.5)/10, 6) AS rounded FROM surfaces""")
def _complexity_rates(t):
    return t.surfaces.select(
        "surface_id", P.unit_for(c("type")).alias("unit"),
        F.round(P.production_rate(c("type"), multi_color=True, high_gloss=True), 6).alias("rate"),
        F.round(P.half_up(c("confidence"), 1), 6).alias("rounded"))
