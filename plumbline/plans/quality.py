"""Quality and revision queries."""

from pyspark.sql import functions as F

from plumbline.operators import diff, quality as op
from plumbline.plans.oracle import CTES
from plumbline.plans.registry import query

c = F.col
S = ("surfaces",)

KEY = "trim(regexp_replace(lower(coalesce(room_label, '')), '\\s+', ' ', 'g'))"

CTES["takeoff"] = """
  SELECT project_id AS takeoff_id, surface_id AS ord, type, room_label, square_footage AS area_sqft,
    linear_footage AS linear_ft, count, substrate, confidence FROM surfaces
  WHERE type IN ('wall','ceiling','trim','door','window') AND room_label IS NOT NULL"""

CTES["rooms_q"] = f"""
  SELECT project_id, {KEY} AS room, sum(CASE WHEN type='wall' THEN coalesce(square_footage,0) ELSE 0 END) AS wall_sqft,
    sum(CASE WHEN type='ceiling' THEN coalesce(square_footage,0) ELSE 0 END) AS floor_sqft,
    sum(CASE WHEN type='wall' THEN coalesce(linear_footage,0) ELSE 0 END) AS wall_lf,
    max(CASE WHEN type='wall' THEN 1 ELSE 0 END) AS wall, max(CASE WHEN type='ceiling' THEN 1 ELSE 0 END) AS ceiling,
    max(CASE WHEN type='door' THEN 1 ELSE 0 END) AS door,
    sum(CASE WHEN type='wall' AND linear_footage >= 5 AND square_footage >= 5 AND
      (square_footage/(linear_footage*9.0) < 0.55 OR square_footage/(linear_footage*9.0) > 1.6) THEN 1 ELSE 0 END) AS wild,
    sum(CASE WHEN coalesce(confidence,0) < 0.6 THEN 1 ELSE 0 END) AS low
  FROM surfaces WHERE status <> 'excluded' GROUP BY 1, 2"""
CTES["facts_q"] = """
  SELECT *, CASE WHEN floor_sqft > 0 THEN wall_sqft/floor_sqft ELSE 0.0 END AS ratio FROM (
  SELECT project_id, sum(wall_sqft) AS wall_sqft, sum(floor_sqft) AS floor_sqft, sum(wall_lf) AS wall_lf,
    sum(wild) AS wild, sum(low) AS low, count(*) FILTER (wall=1) AS wall_rooms,
    count(*) FILTER (room <> '' AND wall=1 AND ceiling=0) AS no_ceiling,
    count(*) FILTER (room <> '' AND door=1 AND wall=0) AS orphan FROM rooms_q GROUP BY 1)"""
FACTS = ("surfaces", "rooms_q", "facts_q")


def takeoff(t):
    return t.surfaces.where(c("type").isin("wall", "ceiling", "trim", "door", "window")
                            & c("room_label").isNotNull()).select(
        c("project_id").alias("takeoff_id"), c("surface_id").alias("ord"), "type", "room_label",
        c("square_footage").alias("area_sqft"), c("linear_footage").alias("linear_ft"), "count", "substrate",
        "confidence")


@query("sanity_totals", FACTS, """
SELECT project_id, round(ratio, 6) AS wall_to_ceiling_ratio, floor_sqft AS total_floor_sqft,
  wall_sqft AS total_wall_sqft, wall_lf AS total_wall_lf, greatest(0.0, floor_sqft-wall_lf*0.25) AS total_net_floor_sqft,
  floor_sqft+wall_lf*0.25 AS total_gross_floor_sqft FROM facts_q""")
def _sanity_totals(t):
    return op.sanity_totals(t.surfaces).withColumn("wall_to_ceiling_ratio", F.round("wall_to_ceiling_ratio", 6))


@query("sanity_flags", FACTS, """
SELECT project_id, flag, severity, message FROM (
SELECT project_id, 'wall-to-floor-low' AS flag, 'warning' AS severity, 'Wall area is only ' ||
  printf('%.2f', floor(ratio*100+0.5)/100) || '× the floor area. For commercial spaces this ratio is usually 2.0–3.5. You may be missing walls — check for interior partitions or split rooms.' AS message
  FROM facts_q WHERE floor_sqft > 100 AND ratio < 1.5
UNION ALL SELECT project_id, 'wall-to-floor-high', 'warning', 'Wall area is ' || printf('%.2f', floor(ratio*100+0.5)/100) ||
  '× the floor area — higher than the typical 2.0–3.5. You may have double-counted shared walls or used floor area in place of wall area.'
  FROM facts_q WHERE floor_sqft > 100 AND ratio > 4
UNION ALL SELECT project_id, 'per-room-wall-implausible', 'warning', wild || CASE WHEN wild=1 THEN ' wall has' ELSE ' walls have' END
  || ' an area that doesn''t match its perimeter × 9 ft. Review these rooms before submitting.' FROM facts_q WHERE wild > 0
UNION ALL SELECT project_id, 'low-confidence-in-bid', 'info', low || CASE WHEN low=1 THEN ' surface has' ELSE ' surfaces have' END
  || ' a confidence below 60%. We recommend manually reviewing ' || CASE WHEN low=1 THEN 'it' ELSE 'them' END
  || ' before submitting the bid.' FROM facts_q WHERE low > 0
UNION ALL SELECT project_id, 'rooms-missing-ceilings', 'info', no_ceiling || CASE WHEN no_ceiling=1 THEN ' room has' ELSE ' rooms have' END
  || ' walls but no ceiling assigned. If those ceilings are being painted, add them; otherwise this is fine.'
  FROM facts_q WHERE no_ceiling > 0 AND wall_rooms >= 3
UNION ALL SELECT project_id, 'orphan-doors', 'info', orphan || CASE WHEN orphan=1 THEN ' door is' ELSE ' doors are' END
  || ' in a room with no walls in the bid. Check whether the room itself is excluded.' FROM facts_q WHERE orphan > 0)""")
def _sanity_flags(t):
    return op.sanity_flags(t.surfaces)


@query("sanity_flag_surfaces", S, """
SELECT project_id, surface_id, 'low-confidence-in-bid' AS flag FROM surfaces WHERE status <> 'excluded' AND confidence < 0.6
UNION ALL SELECT project_id, surface_id, 'per-room-wall-implausible' FROM surfaces WHERE status <> 'excluded' AND type='wall'
  AND linear_footage >= 5 AND square_footage >= 5 AND (square_footage/(linear_footage*9.0) < 0.55 OR square_footage/(linear_footage*9.0) > 1.6)""")
def _flag_surfaces(t):
    return op.flag_surfaces(t.surfaces)


@query("sanity_panel", FACTS, """
SELECT project_id, CAST(0 AS BIGINT) AS errors, CAST((floor_sqft > 100 AND (ratio < 1.5 OR ratio > 4))::INT + (wild > 0)::INT AS BIGINT) AS warnings,
  CAST((low > 0)::INT + (no_ceiling > 0 AND wall_rooms >= 3)::INT + (orphan > 0)::INT AS BIGINT) AS infos
FROM facts_q WHERE warnings + infos > 0""")
def _panel(t):
    return op.flag_panel(op.sanity_flags(t.surfaces))


@query("rooms_missing_ceiling", FACTS, """
SELECT project_id, room FROM rooms_q WHERE wall=1 AND ceiling=0 AND room <> ''""")
def _missing_ceiling(t):
    return op.rooms_missing_ceiling(t.surfaces)


CTES["plaus_q"] = """
  SELECT t.*, w.lf AS wall_lf FROM takeoff t LEFT JOIN (
    SELECT takeoff_id, lower(trim(room_label)) AS room, arg_min(linear_ft, ord) AS lf FROM takeoff WHERE type='wall' GROUP BY 1, 2) w
    ON t.type='ceiling' AND w.takeoff_id=t.takeoff_id AND w.room=lower(trim(t.room_label))"""
PLAUS = ("surfaces", "takeoff", "plaus_q")
_BAD = "(type='wall' AND linear_ft > 0 AND (area_sqft < linear_ft*9.0*0.7 OR area_sqft > linear_ft*9.0*1.15))"
_OVER = "(type='ceiling' AND wall_lf > 0 AND area_sqft > (wall_lf/4)*(wall_lf/4)*1.2)"


@query("plausibility_flags", PLAUS, f"""
SELECT takeoff_id, ord, kind, measured, round(expected_min, 6) AS expected_min, round(expected_max, 6) AS expected_max, note FROM (
SELECT takeoff_id, ord, 'wall_area_vs_perimeter' AS kind, area_sqft AS measured, linear_ft*9.0::DOUBLE*0.7::DOUBLE AS expected_min,
  linear_ft*9.0::DOUBLE*1.15::DOUBLE AS expected_max, 'Wall area ' || CAST(floor(area_sqft+0.5) AS BIGINT) || ' sqft is outside the plausible range '
  || CAST(floor(linear_ft*9.0::DOUBLE*0.7::DOUBLE+0.5) AS BIGINT) || '-' || CAST(floor(linear_ft*9.0::DOUBLE*1.15::DOUBLE+0.5) AS BIGINT)
  || ' sqft for a ' || CAST(floor(linear_ft+0.5) AS BIGINT) || ' ft perimeter room with a 9 ft ceiling.' AS note FROM plaus_q WHERE {_BAD}
UNION ALL SELECT takeoff_id, ord, 'tiny_room_huge_walls', area_sqft, linear_ft*9.0::DOUBLE*0.7::DOUBLE, linear_ft*9.0::DOUBLE, 'Small room ('
  || CAST(floor(linear_ft+0.5) AS BIGINT) || ' ft perimeter) but ' || CAST(floor(area_sqft+0.5) AS BIGINT)
  || ' sqft of walls — likely confused with floor area.' FROM plaus_q WHERE type='wall' AND linear_ft > 0 AND linear_ft < 30 AND area_sqft > 250
UNION ALL SELECT takeoff_id, ord, 'ceiling_oversize', area_sqft, (wall_lf/4)*(wall_lf/4)*0.4::DOUBLE, (wall_lf/4)*(wall_lf/4)*1.2::DOUBLE,
  'Ceiling area ' || CAST(floor(area_sqft+0.5) AS BIGINT) || ' sqft is larger than geometrically possible for a '
  || CAST(floor(wall_lf+0.5) AS BIGINT) || ' ft perimeter room (max ~' || CAST(floor((wall_lf/4)*(wall_lf/4)*1.2::DOUBLE+0.5) AS BIGINT) || ' sqft).'
  FROM plaus_q WHERE {_OVER})""")
def _plaus_flags(t):
    return op.plausibility(takeoff(t))[0].select(
        "takeoff_id", "ord", "kind", "measured", F.round("expected_min", 6).alias("expected_min"),
        F.round("expected_max", 6).alias("expected_max"), "note")


@query("plausibility_corrected", PLAUS, f"""
SELECT takeoff_id, ord, type, round(CASE WHEN {_BAD} THEN linear_ft*9.0*0.93 WHEN {_OVER} THEN (wall_lf/4)*(wall_lf/4)*0.9
  ELSE area_sqft END, 6) AS area_sqft, round(CASE WHEN {_BAD} THEN least(confidence, 0.55) WHEN {_OVER} THEN least(confidence, 0.5)
  ELSE confidence END, 6) AS confidence FROM plaus_q""")
def _plaus_corrected(t):
    return op.plausibility(takeoff(t))[1].select(
        "takeoff_id", "ord", "type", F.round("area_sqft", 6).alias("area_sqft"),
        F.round("confidence", 6).alias("confidence"))


@query("review_counts", S, """
SELECT project_id, count(*) FILTER (status='proposed' AND confidence >= 0.8) AS high,
  count(*) FILTER (status='proposed' AND confidence >= 0.6 AND confidence < 0.8) AS medium,
  count(*) FILTER (status='proposed' AND confidence < 0.6) AS low, count(*) FILTER (status='proposed') AS proposed,
  count(*) FILTER (status IN ('accepted','manual')) AS reviewed FROM surfaces GROUP BY 1""")
def _review(t):
    return op.review_counts(t.surfaces)


@query("reject_low_accept_high", S, """
SELECT surface_id, CASE WHEN status='proposed' AND confidence >= 0.8 THEN 'accepted' ELSE status END AS status FROM surfaces
WHERE NOT (status='proposed' AND confidence < 0.6)""")
def _accept(t):
    return op.accept_high(op.reject_low(t.surfaces)).select("surface_id", "status")


@query("validate_surfaces", S, """
SELECT surface_id, list_filter([CASE WHEN coats > 2 THEN 'coats' END, CASE WHEN confidence > 0.9 THEN 'confidence' END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT * FROM surfaces) WHERE coats > 2 OR confidence > 0.9""")
def _validate(t):
    rules = {**op.surface_rules(), "coats": ~c("coats").between(1, 2), "confidence": ~c("confidence").between(0, 0.9)}
    return op.validate(t.surfaces, rules)[1].select("surface_id", "reasons")


# --- revisions -------------------------------------------------------------------------------
CTES["diff_q"] = f"""
  SELECT *, CASE WHEN old_surfaces=0 THEN 'added' WHEN new_surfaces=0 THEN 'removed' WHEN abs(area_delta_pct) > 0.05 THEN 'resized'
    WHEN old_types=new_types THEN 'unchanged' ELSE 'retyped' END AS change FROM (
  SELECT *, new_area_sqft-old_area_sqft AS area_delta_sqft,
    (new_area_sqft-old_area_sqft)/greatest(old_area_sqft, new_area_sqft, 1.0) AS area_delta_pct FROM (
  SELECT project_id, {KEY} AS room, coalesce(sum(square_footage) FILTER (revision='old'), 0) AS old_area_sqft,
    coalesce(sum(square_footage) FILTER (revision='new'), 0) AS new_area_sqft,
    count(*) FILTER (revision='old') AS old_surfaces, count(*) FILTER (revision='new') AS new_surfaces,
    coalesce(list_sort(list(DISTINCT type) FILTER (revision='old')), []) AS old_types,
    coalesce(list_sort(list(DISTINCT type) FILTER (revision='new')), []) AS new_types,
    coalesce(arg_min(room_label, surface_id) FILTER (revision='old'), arg_min(room_label, surface_id) FILTER (revision='new')) AS room_label
  FROM surfaces WHERE NOT starts_with(type, 'symbol:') GROUP BY 1, 2))"""
DIFF = ("surfaces", "diff_q")


def revisions(t):
    return t.surfaces.where(c("revision") == "old"), t.surfaces.where(c("revision") == "new")


@query("takeoff_diff", DIFF, """
SELECT project_id, room, room_label, change, old_surfaces, new_surfaces, old_area_sqft, new_area_sqft, area_delta_sqft,
  round(area_delta_pct, 6) AS area_delta_pct FROM diff_q WHERE room <> '' AND change <> 'unchanged'""")
def _takeoff_diff(t):
    return diff.diff_rooms(*revisions(t)).withColumn("area_delta_pct", F.round("area_delta_pct", 6))


@query("takeoff_diff_all", DIFF, """
SELECT project_id, room, change, area_delta_sqft FROM diff_q WHERE room <> ''""")
def _takeoff_diff_all(t):
    return diff.largest_first(diff.diff_rooms(*revisions(t), include_unchanged=True)).select(
        "project_id", "room", "change", "area_delta_sqft")


@query("symbol_diff", S, """
SELECT project_id, type, old_count, new_count, new_count-old_count AS delta FROM (
SELECT project_id, regexp_replace(type, '^symbol:', '') AS type, CAST(coalesce(sum(count) FILTER (revision='old'), 0) AS BIGINT) AS old_count,
  CAST(coalesce(sum(count) FILTER (revision='new'), 0) AS BIGINT) AS new_count FROM surfaces WHERE starts_with(type, 'symbol:') GROUP BY 1, 2)
WHERE old_count <> new_count""")
def _symbol_diff(t):
    return diff.diff_symbols(*revisions(t))


@query("diff_summary", DIFF, """
SELECT project_id, count(*) FILTER (room <> '' AND change='added') AS added_rooms, count(*) FILTER (room <> '' AND change='removed') AS removed_rooms,
  count(*) FILTER (room <> '' AND change='resized') AS resized_rooms, CAST(0 AS BIGINT) AS unchanged_rooms, sum(old_area_sqft) AS total_old_sqft,
  sum(new_area_sqft) AS total_new_sqft, sum(new_area_sqft)-sum(old_area_sqft) AS total_delta_sqft,
  round(CASE WHEN sum(old_area_sqft) > 0 THEN (sum(new_area_sqft)-sum(old_area_sqft))/sum(old_area_sqft) ELSE 0 END, 6) AS total_delta_pct
FROM diff_q GROUP BY 1""")
def _diff_summary(t):
    return diff.diff_summary(*revisions(t)).withColumn("total_delta_pct", F.round("total_delta_pct", 6))


@query("validate_projects", ("projects",), """
SELECT project_id, [x FOR x IN [CASE WHEN m = 'cubic' THEN 'measurement_mode' END, CASE WHEN w > 1 THEN 'waste_factor' END, CASE WHEN k < 0 THEN 'markup' END,
  CASE WHEN o > 1 THEN 'overhead_pct' END, CASE WHEN h > 30 OR h < 6 THEN 'ceiling_height_ft' END] IF x IS NOT NULL] AS reasons FROM (
SELECT project_id, CASE WHEN i % 6 = 0 THEN 'cubic' ELSE measurement_mode END AS m, waste_factor + i % 2 AS w, markup - i % 3 * 0.2::DOUBLE AS k, overhead_pct * (i % 12) AS o,
  ceiling_height_ft * (i % 5) AS h FROM (SELECT *, CAST(project_id AS BIGINT) AS i FROM projects))""")
def _projects(t):
    i = c("project_id").cast("bigint")
    odd = t.projects.withColumns({
        "measurement_mode": F.when(i % 6 == 0, "cubic").otherwise(c("measurement_mode")), "waste_factor": c("waste_factor") + i % 2,
        "markup": c("markup") - i % 3 * 0.2, "overhead_pct": c("overhead_pct") * (i % 12), "ceiling_height_ft": c("ceiling_height_ft") * (i % 5)})
    good, bad = op.validate(odd, op.project_rules())
    return good.select("project_id", F.array().cast("array<string>").alias("reasons")).unionByName(bad.select("project_id", "reasons"))
