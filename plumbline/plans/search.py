"""Scan, filter, count and top-k queries."""

from pyspark.sql import functions as F

from plumbline import refdata as R
from plumbline.functions import text as T
from plumbline.operators import search as op
from plumbline.plans.oracle import CTES, case
from plumbline.plans.quality import takeoff
from plumbline.plans.registry import query

c = F.col
S = ("surfaces",)
PG = ("plan_pages",)
FILTER = op.ToolFilter(surface_type="wall", rooms="bolt | GEAR||ring")
WHERE = ("type='wall' AND (contains(lower(room_label), 'bolt') OR contains(lower(room_label), 'gear') "
         "OR contains(lower(room_label), 'ring'))")


@query("tool_filter", S, f"SELECT project_id, surface_id FROM surfaces WHERE {WHERE}")
def _tool_filter(t):
    return t.surfaces.where(op.tool_filter(FILTER)).select("project_id", "surface_id")


@query("room_synonyms", S, """
SELECT surface_id FROM surfaces WHERE type='ceiling' AND (lower(room_label) LIKE '%hall%' OR lower(room_label) LIKE '%corridor%'
  OR lower(room_label) LIKE '%passageway%' OR lower(room_label) LIKE '%cold%')""")
def _synonyms(t):
    f = op.ToolFilter(surface_type="ceiling", rooms=T.expand_rooms("corridor|cold"))
    return t.surfaces.where(op.tool_filter(f)).select("surface_id")


@query("query_quantities", S, f"""
SELECT project_id, count(*) AS surface_count, coalesce(sum(square_footage), 0) AS square_footage,
  coalesce(sum(linear_footage), 0) AS linear_footage, CAST(coalesce(sum(count), 0) AS BIGINT) AS item_count
FROM surfaces WHERE {WHERE} GROUP BY 1""")
def _quantities(t):
    return op.query_quantities(t.surfaces, FILTER)


@query("edit_preview", S, f"""
SELECT project_id, count(*) AS affected, count(*) > 2 AS needs_confirmation FROM surfaces WHERE {WHERE} GROUP BY 1""")
def _preview(t):
    return op.preview(t.surfaces, FILTER, threshold=2)


@query("search_surfaces", S, """
SELECT project_id, surface_id, hits, rank FROM (SELECT project_id, surface_id, count(*) OVER (PARTITION BY project_id) AS hits,
  CAST(row_number() OVER (PARTITION BY project_id ORDER BY surface_id) AS INT) AS rank FROM surfaces
  WHERE regexp_matches(lower(room_label), '(cold|hot) +[a-m]')) WHERE rank <= 10""")
def _search(t):
    q = op.SearchQuery(rooms="(cold|hot) +[a-m]")
    return op.search(t.surfaces, q).select("project_id", "surface_id", "hits", "rank")


@query("symbol_rooms", S, """
SELECT project_id, regexp_replace(type, '^symbol:', '') AS symbol, coalesce(room_label, '(no room)') AS room_label,
  CAST(sum(coalesce(count, 0)) AS BIGINT) AS total FROM surfaces WHERE starts_with(type, 'symbol:') GROUP BY 1, 2, 3
UNION ALL SELECT project_id, regexp_replace(type, '^symbol:', ''), NULL, CAST(sum(coalesce(count, 0)) AS BIGINT) FROM surfaces
WHERE starts_with(type, 'symbol:') GROUP BY 1, 2""")
def _symbol_rooms(t):
    return op.symbol_rooms(t.surfaces)


@query("symbol_counts", S, """
SELECT project_id, regexp_replace(type, '^symbol:', '') AS symbol, CAST(sum(coalesce(count, 0)) AS BIGINT) AS total,
  CASE type WHEN 'symbol:toilet' THEN 'Plumbing' ELSE 'Openings' END AS category,
  CASE type WHEN 'symbol:toilet' THEN 1 ELSE 0 END AS category_order,
  CASE type WHEN 'symbol:toilet' THEN 'Toilet' ELSE 'Single Door' END AS title
FROM surfaces WHERE starts_with(type, 'symbol:') GROUP BY project_id, type""")
def _symbol_counts(t):
    return op.symbol_counts(t.surfaces)


@query("symbol_categories", S, """
SELECT project_id, CASE type WHEN 'symbol:toilet' THEN 'plumbing' ELSE 'openings' END AS category,
  CAST(sum(coalesce(count, 0)) AS BIGINT) AS total FROM surfaces WHERE starts_with(type, 'symbol:') GROUP BY 1, 2""")
def _symbol_categories(t):
    return op.category_totals(t.surfaces)


@query("type_counts", S, """
SELECT project_id, type, count(*) AS surfaces FROM surfaces WHERE status <> 'excluded' GROUP BY 1, 2""")
def _type_counts(t):
    return op.type_counts(t.surfaces)


@query("dashboard", ("projects", "plan_pages", "surfaces"), """
SELECT p.project_id, p.name, coalesce(g.n, 0) AS pages, coalesce(s.n, 0) AS surfaces FROM projects p
LEFT JOIN (SELECT project_id, count(*) AS n FROM plan_pages GROUP BY 1) g USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n FROM surfaces GROUP BY 1) s USING (project_id)""")
def _dashboard(t):
    return op.dashboard(t.projects, t.plan_pages, t.surfaces)


@query("known_rooms", S, """
SELECT DISTINCT project_id, trim(room_label) AS room_label FROM surfaces WHERE trim(room_label) <> ''""")
def _known(t):
    return op.known_values(t.surfaces, "room_label")


@query("project_list", ("projects",), "SELECT project_id, name, updated_epoch FROM projects")
def _projects(t):
    return op.project_list(t.projects).select("project_id", "name", "updated_epoch")


@query("project_pages", ("projects", "plan_pages"), """
SELECT p.project_id, p.name, g.plan_page_id, g.page_number FROM projects p LEFT JOIN plan_pages g USING (project_id)""")
def _project_pages(t):
    return op.project_pages(t.projects, t.plan_pages).select("project_id", "name", "plan_page_id", "page_number")


@query("project_surfaces", ("surfaces",), """
SELECT surface_id, type, created_at FROM surfaces WHERE project_id='7' AND status <> 'excluded'""")
def _project_surfaces(t):
    return op.scan_surfaces(t.surfaces, "7").where(c("status") != "excluded").select(
        "surface_id", "type", "created_at").orderBy("created_at")


@query("expand_pages", (), """
SELECT CAST(s_suppkey AS VARCHAR) AS plan_id, CAST(n AS INT) AS page_number FROM supplier, range(1, 9) r(n)
WHERE n <= s_suppkey % 7 + 1""")
def _expand(t):
    plans = t.raw("supplier").select(c("s_suppkey").cast("string").alias("plan_id"),
                                     (c("s_suppkey") % 7 + 1).cast("int").alias("page_count"))
    return op.expand_pages(plans).drop("page_count")


@query("chat_transcript", ("messages",), """
SELECT conv_id, turn, role, length(text) AS chars FROM messages WHERE role IN ('user', 'assistant')""")
def _transcript(t):
    return op.transcript(t.messages).select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("chars"))


@query("chat_history", ("messages",), """
SELECT conv_id, turn, rank, 'oldest' AS side FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS rank FROM messages) WHERE rank <= 3
UNION ALL SELECT conv_id, turn, rank, 'latest' FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS rank FROM messages) WHERE rank <= 3""")
def _history(t):
    pick = lambda latest, side: op.chat_history(t.messages, 3, latest).select(
        "conv_id", "turn", "rank", F.lit(side).alias("side"))
    return pick(False, "oldest").unionByName(pick(True, "latest"))


@query("first_eligible_page", PG, """
SELECT project_id, plan_page_id, page_number FROM plan_pages WHERE page_type IN ('floor_plan', 'rcp') AND NOT hidden
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY page_number, plan_page_id) = 1""")
def _first_page(t):
    return op.first_eligible_page(t.plan_pages)


@query("page_rail", PG, """
SELECT plan_page_id, CASE WHEN hidden THEN 'hidden' WHEN page_type IN ('floor_plan', 'rcp') THEN 'floor'
  WHEN page_type IS NULL THEN 'unclassified' ELSE 'other' END AS rail FROM plan_pages""")
def _rail(t):
    return op.page_rail(t.plan_pages).select("plan_page_id", "rail")


@query("pages_to_classify", PG, "SELECT plan_page_id FROM plan_pages WHERE page_type IS NULL")
def _classify(t):
    return op.pages_to_classify(t.plan_pages).select("plan_page_id")


CTES["audit"] = """
  SELECT event_id AS audit_id, CAST(user_id AS VARCHAR) AS project_id, event_type AS action,
    CASE WHEN event_id % 3 <> 0 THEN props END AS before, ts AS created_at FROM events"""


def audit(t):
    return t.raw("events").select(
        c("event_id").alias("audit_id"), c("user_id").cast("string").alias("project_id"),
        c("event_type").alias("action"), F.when(c("event_id") % 3 != 0, c("props")).alias("before"),
        c("ts").cast("timestamp_ntz").alias("created_at"))


@query("recent_audit", ("audit",), """
SELECT audit_id, project_id, rank, before IS NOT NULL AS undoable FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id
  ORDER BY created_at DESC, audit_id DESC) AS INT) AS rank FROM audit) WHERE rank <= 20""")
def _audit(t):
    return op.recent_audit(audit(t), 20).select("audit_id", "project_id", "rank", "undoable")


@query("claims_summary", ("surfaces", "takeoff"), """
SELECT takeoff_id, room_label, room_label || ': walls=' || ws || ' sqft (perimeter ' || wl || ' lf), ceil=' || cs || ' sqft, trim=' || tl
  || ' lf, doors=' || d || ', windows=' || w AS claim FROM (
SELECT takeoff_id, room_label, CAST(floor(coalesce(sum(area_sqft) FILTER (type='wall'), 0)+0.5) AS BIGINT) AS ws,
  CAST(floor(coalesce(sum(linear_ft) FILTER (type='wall'), 0)+0.5) AS BIGINT) AS wl,
  CAST(floor(coalesce(sum(area_sqft) FILTER (type='ceiling'), 0)+0.5) AS BIGINT) AS cs,
  CAST(floor(coalesce(sum(linear_ft) FILTER (type='trim'), 0)+0.5) AS BIGINT) AS tl,
  CAST(coalesce(sum(count) FILTER (type='door'), 0) AS BIGINT) AS d, CAST(coalesce(sum(count) FILTER (type='window'), 0) AS BIGINT) AS w
FROM takeoff GROUP BY 1, 2)""")
def _claims(t):
    return op.claims_summary(takeoff(t))


_PAINT = " ".join(f"WHEN contains(m, '{p}') THEN '{p}'" for p in R.COMMAND_PAINTS)
_PICK = "CASE CAST(user_id % 8 AS INT) WHEN 0 THEN 'Change all bathroom walls to semi-gloss' WHEN 1 THEN 'what is the TOTAL square footage in the lobby?' " \
        "WHEN 2 THEN 'exclude all hallway doors' WHEN 3 THEN 'set waste to ' || k || '%' WHEN 4 THEN 'markup ' || k || ' percent please' " \
        "WHEN 5 THEN 'use 0.' || k || ' waste' WHEN 6 THEN 'set markup to ' || k ELSE 'paint the office ' || k END"


@query("parse_commands", (), f"""
WITH m AS (SELECT event_id, lower({_PICK}) AS m, k FROM (SELECT event_id, user_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)),
x AS (SELECT *, CASE {_PAINT} END AS paint, nullif(regexp_extract(m, '\\b(bathroom|patient room|corridor|lobby|hallway|kitchen|office)s?\\b', 1), '') AS room,
  nullif(regexp_extract(m, '\\b(wall|ceiling|trim|door|window)s?\\b', 1), '') AS kind FROM m),
y AS (SELECT *, CASE WHEN (contains(m, 'change') OR contains(m, 'update') OR contains(m, 'set')) AND paint IS NOT NULL THEN 'update_surfaces'
  WHEN contains(m, 'total') AND (contains(m, 'square') OR contains(m, 'sqft') OR contains(m, 'footage')) THEN 'query_quantities'
  WHEN contains(m, 'exclude') THEN 'exclude_surfaces' WHEN regexp_matches(m, '\\bwaste\\b') THEN 'set_waste_factor'
  WHEN regexp_matches(m, '\\bmarkup\\b') THEN 'set_markup' END AS tool FROM x)
SELECT event_id, tool, CASE WHEN tool IN ('update_surfaces','query_quantities','exclude_surfaces') THEN upper(room[1]) || room[2:] END AS rooms,
  CASE WHEN tool IN ('update_surfaces','exclude_surfaces') THEN kind END AS surface_type,
  CASE WHEN tool='update_surfaces' THEN paint END AS paint_type,
  CASE WHEN tool IN ('set_waste_factor','set_markup') THEN CASE WHEN contains(m, '%') OR contains(m, 'percent') THEN least(k::DOUBLE, 100.0)
    WHEN contains(m, '0.') AND ('0.' || k)::DOUBLE > 0 THEN floor(('0.' || k)::DOUBLE*100*10+0.5)/10 END END AS percentage FROM y""")
def _parse(t):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    u = c("user_id") % 8
    text = (F.when(u == 0, "Change all bathroom walls to semi-gloss")
            .when(u == 1, "what is the TOTAL square footage in the lobby?")
            .when(u == 2, "exclude all hallway doors").when(u == 3, F.concat(F.lit("set waste to "), k, F.lit("%")))
            .when(u == 4, F.concat(F.lit("markup "), k, F.lit(" percent please")))
            .when(u == 5, F.concat(F.lit("use 0."), k, F.lit(" waste")))
            .when(u == 6, F.concat(F.lit("set markup to "), k)).otherwise(F.concat(F.lit("paint the office "), k)))
    return t.raw("events").select("event_id", op.parse_command(text).alias("p")).select("event_id", "p.*")


@query("scope_text", ("projects",), """
SELECT project_id, CASE WHEN s='draft' THEN 'lead or asbestos abatement, wall covering / wallpaper' ELSE 'removal of existing finishes' END AS scope
FROM (SELECT project_id, status AS s FROM projects)""")
def _scope(t):
    chosen = F.when(c("status") == "draft", F.array(F.lit("wall-covering"), F.lit("lead-asbestos"))).otherwise(
        F.array(F.lit("removal-finishes"), F.lit("unknown")))
    return t.projects.select("project_id", op.scope_text(chosen).alias("scope"))
