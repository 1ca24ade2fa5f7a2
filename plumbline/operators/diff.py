"""Comparison of two takeoffs of the same projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import text as T

c = F.col


def _both(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows in one table, so that one grouping replaces two plus an outer join."""
    return (old.withColumn("_new", F.lit(False))
            .unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True))


def _side(new: bool, value, neutral):
    return F.when(c("_new") == new, value).otherwise(neutral)


def _measured(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both takeoffs without symbols, with their room key and their area on either side."""
    area = F.coalesce("square_footage", F.lit(0.0))
    return (_both(old, new).where(~c("type").startswith("symbol:")).withColumn("room", T.room_key(c("room_label")))
            .withColumn("_oa", _side(False, area, 0.0)).withColumn("_na", _side(True, area, 0.0)))


def _delta() -> tuple[Column, Column]:
    delta = c("new_area_sqft") - c("old_area_sqft")
    return delta, delta / F.greatest("old_area_sqft", "new_area_sqft", F.lit(1.0))


def _change(tol: float, same: Column) -> Column:
    return (F.when(c("old_surfaces") == 0, "added").when(c("new_surfaces") == 0, "removed")
            .when(F.abs(_delta()[1]) > tol, "resized").otherwise(same))


def _sizes(old: DataFrame, new: DataFrame, tol: float) -> DataFrame:
    """Areas and change per room without regard to types: retyped rooms count as unchanged."""
    return _measured(old, new).groupBy("project_id", "room").agg(
        F.sum("_oa").alias("old_area_sqft"), F.sum("_na").alias("new_area_sqft"),
        F.count_if(~c("_new")).alias("old_surfaces"), F.count_if(c("_new")).alias("new_surfaces")).withColumn(
        "change", _change(tol, F.lit("unchanged")))


def _rooms(old: DataFrame, new: DataFrame, tol: float) -> DataFrame:
    first = lambda is_new, by, value: F.min_by(
        _side(is_new, value, F.lit(None)), _side(is_new, c(by), F.lit(None)))
    per_type = (
        _measured(old, new).groupBy("project_id", "room", "type")
        .agg(F.sum("_oa").alias("old_area"), F.sum("_na").alias("new_area"),
             F.count_if(~c("_new")).alias("old_n"), F.count_if(c("_new")).alias("new_n"),
             first(False, "surface_id", F.struct("room_label", "surface_id")).alias("_o"),
             first(True, "surface_id", F.struct("room_label", "surface_id")).alias("_n")))
    one_sided = c("type").isNotNull() & ((c("old_n") == 0) != (c("new_n") == 0))
    grouped = per_type.groupBy("project_id", "room").agg(
        F.sum("old_area").alias("old_area_sqft"), F.sum("new_area").alias("new_area_sqft"),
        F.sum("old_n").alias("old_surfaces"), F.sum("new_n").alias("new_surfaces"),
        F.bool_or(one_sided).alias("_retyped"),
        F.min_by("_o", "_o.surface_id").alias("_o"), F.min_by("_n", "_n.surface_id").alias("_n"))
    delta, share = _delta()
    return (grouped.withColumn("area_delta_sqft", delta).withColumn("area_delta_pct", share)
            .withColumn("change", _change(tol, F.when(c("_retyped"), "retyped").otherwise("unchanged")))
            .withColumn("room_label", F.coalesce("_o.room_label", "_n.room_label"))
            .drop("_retyped", "_o", "_n"))


def diff_rooms(old: DataFrame, new: DataFrame, tol: float = 0.05, include_unchanged: bool = False) -> DataFrame:
    """Added, removed, resized and retyped rooms per project; unlabelled rows have no room."""
    rooms = _rooms(old, new, tol).where(c("room") != "")
    return rooms if include_unchanged else rooms.where(c("change") != "unchanged")


def largest_first(rooms: DataFrame) -> DataFrame:
    return rooms.orderBy("project_id", F.desc(F.abs("area_delta_sqft")), "room")


def diff_symbols(old: DataFrame, new: DataFrame, include_unchanged: bool = False) -> DataFrame:
    n = F.coalesce(c("count").cast("bigint"), F.lit(0))
    out = (_both(old, new).where(c("type").startswith("symbol:"))
           .groupBy("project_id", T.symbol_name(c("type")).alias("type"))
           .agg(F.sum(_side(False, n, 0)).alias("old_count"), F.sum(_side(True, n, 0)).alias("new_count"))
           .withColumn("delta", c("new_count") - c("old_count")))
    return out if include_unchanged else out.where(c("delta") != 0)


def diff_summary(old: DataFrame, new: DataFrame, tol: float = 0.05, include_unchanged: bool = False) -> DataFrame:
    """Counts per kind of change and area totals.

    Totals include unlabelled rows; retyped rooms are not counted; unchanged rooms are counted only
    when they are part of the report, and only then are rooms told apart by type.
    """
    named = c("room") != ""
    shown = named & F.lit(include_unchanged)
    count = lambda kind, base=named: F.count_if(base & (c("change") == kind))
    rooms = _rooms(old, new, tol) if include_unchanged else _sizes(old, new, tol)
    out = rooms.groupBy("project_id").agg(
        count("added").alias("added_rooms"), count("removed").alias("removed_rooms"),
        count("resized").alias("resized_rooms"), count("unchanged", shown).alias("unchanged_rooms"),
        F.sum("old_area_sqft").alias("total_old_sqft"), F.sum("new_area_sqft").alias("total_new_sqft"))
    delta = c("total_new_sqft") - c("total_old_sqft")
    return out.withColumn("total_delta_sqft", delta).withColumn(
        "total_delta_pct", F.when(c("total_old_sqft") > 0, delta / c("total_old_sqft")).otherwise(0.0))
