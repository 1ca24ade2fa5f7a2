"""Cross-row checks, plausibility corrections, review queues and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import refdata as R
from plumbline.functions import pricing as P, text as T

c = F.col

#: assumed ceiling of the checks, and the wall band per running foot
CHECK_HEIGHT_FT = 9.0
WALL_BAND_FT = 0.25


def _wild_wall() -> Column:
    lf, sqft = F.coalesce("linear_footage", F.lit(0.0)), F.coalesce("square_footage", F.lit(0.0))
    ratio = F.try_divide(sqft, lf * CHECK_HEIGHT_FT)
    return (c("type") == "wall") & (lf >= 5) & (sqft >= 5) & ((ratio < 0.55) | (ratio > 1.6))


def _low_confidence() -> Column:
    return F.coalesce("confidence", F.lit(0.0)) < 0.6


def _room_facts(surfaces: DataFrame) -> DataFrame:
    """Per project and room: the sums and presence marks that every check below needs.

    Grouping by room first keeps a very large project spread over many tasks.
    """
    def total(kind: str, column: str) -> Column:
        return F.sum(F.when(c("type") == kind, F.coalesce(column, F.lit(0.0))).otherwise(0.0))
    def has(kind: str) -> Column:
        return F.max((c("type") == kind).cast("int"))
    return (surfaces.where(c("status") != "excluded")
            .groupBy("project_id", T.room_key(c("room_label")).alias("room"))
            .agg(total("wall", "square_footage").alias("wall_sqft"),
                 total("ceiling", "square_footage").alias("floor_sqft"),
                 total("wall", "linear_footage").alias("wall_lf"),
                 has("wall").alias("wall"), has("ceiling").alias("ceiling"), has("door").alias("door"),
                 F.sum(_wild_wall().cast("bigint")).alias("wild"),
                 F.sum(_low_confidence().cast("bigint")).alias("low")))


def _project_facts(surfaces: DataFrame) -> DataFrame:
    named = c("room") != ""
    count = lambda cond: F.sum(cond.cast("bigint"))
    return (_room_facts(surfaces).groupBy("project_id").agg(
        F.sum("wall_sqft").alias("total_wall_sqft"), F.sum("floor_sqft").alias("total_floor_sqft"),
        F.sum("wall_lf").alias("total_wall_lf"), F.sum("wild").alias("wild"), F.sum("low").alias("low"),
        count(c("wall") == 1).alias("wall_rooms"),
        count(named & (c("wall") == 1) & (c("ceiling") == 0)).alias("no_ceiling"),
        count(named & (c("door") == 1) & (c("wall") == 0)).alias("orphan_doors"))
        .withColumn("wall_to_ceiling_ratio", F.when(c("total_floor_sqft") > 0,
                                                    c("total_wall_sqft") / c("total_floor_sqft")).otherwise(0.0)))


def sanity_totals(surfaces: DataFrame) -> DataFrame:
    """Area totals with the wall band taken off and added back."""
    band = c("total_wall_lf") * WALL_BAND_FT
    return _project_facts(surfaces).select(
        "project_id", "wall_to_ceiling_ratio", "total_floor_sqft", "total_wall_sqft", "total_wall_lf",
        F.greatest(F.lit(0.0), c("total_floor_sqft") - band).alias("total_net_floor_sqft"),
        (c("total_floor_sqft") + band).alias("total_gross_floor_sqft"))


def sanity_flags(surfaces: DataFrame) -> DataFrame:
    """One row per raised flag (E5, D5, D6); the surfaces behind a flag are in ``flag_surfaces``."""
    def flag(cond: Column, name: str, severity: str, *message: Column | str) -> Column:
        text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])
        return F.when(cond, F.struct(F.lit(name).alias("flag"), F.lit(severity).alias("severity"),
                                     text.alias("message")))
    ratio, big = c("wall_to_ceiling_ratio"), c("total_floor_sqft") > 100
    n = lambda col: c(col).cast("string")
    shown = T.fixed(ratio, 2)
    # fixed values: message wording
    flags = F.array(
        flag(big & (ratio < 1.5), "wall-to-floor-low", "warning", "Wall area is only ", shown,
             "× the floor area. For commercial spaces this ratio is usually 2.0–3.5. You may be missing walls — "
             "check for interior partitions or split rooms."),
        flag(big & (ratio > 4), "wall-to-floor-high", "warning", "Wall area is ", shown,
             "× the floor area — higher than the typical 2.0–3.5. You may have double-counted shared walls or "
             "used floor area in place of wall area."),
        flag(c("wild") > 0, "per-room-wall-implausible", "warning", n("wild"), " wall",
             T.plural(c("wild"), " has", "s have"),
             " an area that doesn't match its perimeter × 9 ft. Review these rooms before submitting."),
        flag(c("low") > 0, "low-confidence-in-bid", "info", n("low"), " surface", T.plural(c("low"), "", "s"), " ",
             T.plural(c("low"), "has", "have"), " a confidence below 60%. We recommend manually reviewing ",
             T.plural(c("low"), "it", "them"), " before submitting the bid."),
        flag((c("no_ceiling") > 0) & (c("wall_rooms") >= 3), "rooms-missing-ceilings", "info", n("no_ceiling"),
             " room", T.plural(c("no_ceiling"), "", "s"), " ", T.plural(c("no_ceiling"), "has", "have"),
             " walls but no ceiling assigned. If those ceilings are being painted, add them; otherwise this is fine."),
        flag(c("orphan_doors") > 0, "orphan-doors", "info", n("orphan_doors"), " door",
             T.plural(c("orphan_doors"), " is", "s are"),
             " in a room with no walls in the bid. Check whether the room itself is excluded."))
    return (_project_facts(surfaces)
            .select("project_id", F.inline(F.filter(flags, lambda f: f.isNotNull()))))


def flag_surfaces(surfaces: DataFrame) -> DataFrame:
    """The surfaces behind the id-carrying flags, one row each instead of one list per project."""
    names = F.array(F.when(_wild_wall(), F.lit("per-room-wall-implausible")),
                    F.when(_low_confidence(), F.lit("low-confidence-in-bid")))
    return (surfaces.where(c("status") != "excluded")
            .select("project_id", "surface_id", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("flag")))


def flag_panel(flags: DataFrame) -> DataFrame:
    """Flags per severity (the panel header)."""
    return flags.groupBy("project_id").agg(
        *[F.count_if(c("severity") == s).alias(s + "s") for s in ("error", "warning", "info")])


def rooms_missing_ceiling(surfaces: DataFrame) -> DataFrame:
    return (_room_facts(surfaces).where((c("wall") == 1) & (c("ceiling") == 0) & (c("room") != ""))
            .select("project_id", "room"))


# --- plausibility (J13, D11) -------------------------------------------------------------------
def plausibility(takeoff: DataFrame, height: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Flags and the corrected takeoff.

    ``takeoff`` rows: takeoff_id, ord, type, room_label, area_sqft, linear_ft, confidence.  The
    ceiling test compares with the first wall of the same room in list order.
    """
    ht = F.lit(CHECK_HEIGHT_FT) if height is None else height
    room = F.lower(F.trim("room_label"))
    walls = takeoff.where(c("type") == "wall")
    lf = walls.groupBy("takeoff_id", room.alias("_room")).agg(
        F.min_by(F.struct("linear_ft"), "ord").alias("_wall"))
    # every row joins by its own room, so a large takeoff spreads over its rooms
    known = (takeoff.withColumn("_room", room).join(lf, ["takeoff_id", "_room"], "left")
             .withColumn("_lf", F.when(c("type") == "ceiling", c("_wall.linear_ft")))
             .withColumn("_h", ht))
    area, own = c("area_sqft"), c("linear_ft")
    is_wall = (c("type") == "wall") & (own > 0) & area.isNotNull()
    low, high = own * c("_h") * 0.7, own * c("_h") * 1.15
    bad_wall = F.coalesce(is_wall & ((area < low) | (area > high)), F.lit(False))
    tiny = F.coalesce(is_wall & (own < 30) & (area > 250), F.lit(False))
    square = (c("_lf") / 4) * (c("_lf") / 4)
    oversize = F.coalesce((c("type") == "ceiling") & (c("_lf") > 0) & (area > square * 1.2), F.lit(False))

    def flag(cond: Column, kind: str, lo: Column, hi: Column, *note: Column | str) -> Column:
        text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in note])
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), area.alias("measured"), lo.alias("expected_min"),
                                     hi.alias("expected_max"), text.alias("note")))
    # fixed values: message wording
    flags = F.array(
        flag(bad_wall, "wall_area_vs_perimeter", low, high, "Wall area ", T.whole(area),
             " sqft is outside the plausible range ", T.whole(low), "-", T.whole(high), " sqft for a ",
             T.whole(own), " ft perimeter room with a ", F.format_string("%.0f", c("_h")), " ft ceiling."),
        flag(tiny, "tiny_room_huge_walls", low, own * c("_h"), "Small room (", T.whole(own), " ft perimeter) but ",
             T.whole(area), " sqft of walls — likely confused with floor area."),
        flag(oversize, "ceiling_oversize", square * 0.4, square * 1.2, "Ceiling area ", T.whole(area),
             " sqft is larger than geometrically possible for a ", T.whole(c("_lf")), " ft perimeter room (max ~",
             T.whole(square * 1.2), " sqft)."))
    raised = known.select("takeoff_id", "ord", c("type").alias("surface_kind"), "room_label",
                          F.inline(F.filter(flags, lambda f: f.isNotNull())))
    corrected = known.select(
        *[c(n) for n in takeoff.columns if n not in ("area_sqft", "confidence")],
        F.when(bad_wall, own * c("_h") * 0.93).when(oversize, square * 0.9).otherwise(area).alias("area_sqft"),
        F.when(bad_wall, F.least("confidence", F.lit(0.55))).when(oversize, F.least("confidence", F.lit(0.5)))
        .otherwise(c("confidence")).alias("confidence"))
    return raised, corrected


# --- review queue ------------------------------------------------------------------------------
def review_counts(surfaces: DataFrame) -> DataFrame:
    """Proposed rows per confidence band and review progress."""
    band = P.confidence_band(c("confidence"))
    proposed = c("status") == "proposed"
    return surfaces.groupBy("project_id").agg(
        *[F.count_if(proposed & (band == b)).alias(b) for b in ("high", "medium", "low")],
        F.count_if(proposed).alias("proposed"),
        F.count_if(c("status").isin("accepted", "manual")).alias("reviewed"))


def reject_low(surfaces: DataFrame) -> DataFrame:
    """Next state after deleting every low-confidence proposal."""
    return surfaces.where(~((c("status") == "proposed") & (P.confidence_band(c("confidence")) == "low")))


def accept_high(surfaces: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Next state after accepting every high-confidence proposal."""
    hit = (c("status") == "proposed") & (c("confidence") >= at_least)
    return surfaces.withColumn("status", F.when(hit, "accepted").otherwise(c("status")))


# --- validation (C17) --------------------------------------------------------------------------
def surface_rules() -> dict[str, Column]:
    """Name of the violated rule -> condition for a violation (NULL counts as no violation).

    The surface type is an open set of names, so only an empty one is refused.
    """
    return {
        "project_id": F.coalesce(c("project_id"), F.lit("")) == "",
        "plan_page_id": F.coalesce(c("plan_page_id"), F.lit("")) == "",
        "type": F.coalesce(c("type"), F.lit("")) == "", "coats": ~c("coats").between(1, 10),
        "status": ~c("status").isin(R.STATUSES), "source": ~c("source").isin(R.SOURCES),
        "finish_type": ~c("finish_type").isin(R.FINISHES),
    }


def path_rules() -> dict[str, Column]:
    """Extra rules for rows that carry traced geometry."""
    return {
        "polygon": F.size("polygon") < 2, "path_points": F.size("path_points") < 2,
        "wall_height_ft": c("wall_height_ft") <= 0, "height_basis": ~c("height_basis").isin(R.HEIGHT_BASES),
        "derivation": ~c("derivation").isin(R.DERIVATIONS),
    }


def project_rules() -> dict[str, Column]:
    return {
        "measurement_mode": ~c("measurement_mode").isin("net", "gross", "pca"),
        "waste_factor": ~c("waste_factor").between(0, 1), "markup": ~c("markup").between(0, 1),
        "overhead_pct": ~c("overhead_pct").between(0, 1), "ceiling_height_ft": ~c("ceiling_height_ft").between(6, 30),
    }


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy every rule, and the rest with the names of the broken ones."""
    reasons = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
                                 for name, cond in rules.items()]), lambda r: r.isNotNull())
    marked = df.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)
