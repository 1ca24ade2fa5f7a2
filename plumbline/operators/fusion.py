"""Combining a model's takeoff with printed tables, findings and extracted geometry.

A takeoff is ``takeoff_id, ord, type, room_label, area_sqft, linear_ft, count, substrate, confidence,
derivation``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import plantext as X, pricing as P, text as T
from plumbline.operators.quality import plausibility

c = F.col


def room_lookup(labels: DataFrame, rooms: DataFrame) -> DataFrame:
    """Label -> extracted room: equal folded keys, else the first room where one key starts the other.

    ``rooms``: takeoff_id, ord, label, ...; of equal keys the first room counts.  Prefix matches are
    equality joins on prefixes as long as some key of the other side, so no pair of unrelated labels is ever formed.  Short keys
    of the room list (under three characters) only match exactly.
    """
    facts = [n for n in rooms.columns if n not in ("takeoff_id", "label", "ord")]
    keyed = (rooms.withColumn("rk", T.alnum_key(c("label"))).where(c("rk") != "")
             .groupBy("takeoff_id", "rk").agg(F.min("ord").alias("ro"),
                                              F.min_by(F.struct(*facts), "ord").alias("room")))
    asked = labels.select("takeoff_id", T.alnum_key(c("room_label")).alias("k")).where(c("k") != "").distinct()
    long_rooms = keyed.where(F.length("rk") >= 3)
    direct = asked.join(keyed, (asked["takeoff_id"] == keyed["takeoff_id"]) & (c("k") == c("rk"))).select(
        asked["takeoff_id"], "k", "rk", F.struct(F.lit(0).alias("p"), c("ro")).alias("o"))
    sizes = long_rooms.groupBy("takeoff_id").agg(F.collect_set(F.length("rk")).alias("_n"))
    starts = asked.where(F.length("k") >= 3).join(sizes, "takeoff_id").select("takeoff_id", "k", F.explode(F.transform(
        F.filter("_n", lambda n: n <= F.length("k")), lambda n: F.substr(c("k"), F.lit(1), n))).alias("rk")).join(
        long_rooms.select("takeoff_id", "rk", "ro"), ["takeoff_id", "rk"]).select(
        "takeoff_id", "k", "rk", F.struct(F.lit(1).alias("p"), c("ro")).alias("o"))
    # a label of one or two characters can still start a room key; only beginnings as long as some label of the takeoff are spread
    lengths = asked.groupBy("takeoff_id").agg(F.collect_set(F.length("k")).alias("_n"))
    extends = long_rooms.select("takeoff_id", "rk", "ro").join(lengths, "takeoff_id").withColumn("k", F.explode(F.transform(
        F.filter("_n", lambda n: n <= F.length("rk")), lambda n: F.substr(c("rk"), F.lit(1), n)))).join(
        asked, ["takeoff_id", "k"]).select("takeoff_id", "k", "rk", F.struct(F.lit(1).alias("p"), c("ro")).alias("o"))
    best = (direct.unionByName(starts).unionByName(extends).groupBy("takeoff_id", "k")
            .agg(F.min_by("rk", "o").alias("rk")))
    return best.join(keyed.select("takeoff_id", "rk", "room"), ["takeoff_id", "rk"]).select("takeoff_id", "k", "room")


def fuse_geometry(takeoff: DataFrame, rooms: DataFrame, ceiling_ft: Column) -> DataFrame:
    """Replace measurements by extracted geometry; what finds no room loses its numbers.

    ``rooms``: takeoff_id, ord, label, area_sqft, perimeter_ft, derivation.
    """
    found = room_lookup(takeoff, rooms)
    joined = takeoff.withColumn("k", T.alnum_key(c("room_label"))).join(found, ["takeoff_id", "k"], "left").drop("k")
    run, kind = c("room.perimeter_ft"), c("type")
    return (joined.withColumn("area_sqft", F.when(kind == "wall", P.half_up(run * ceiling_ft, 1))
                              .when(kind == "ceiling", c("room.area_sqft")).otherwise(c("area_sqft")))
            .withColumn("linear_ft", F.when(kind.isin("wall", "trim"), run).otherwise(c("linear_ft")))
            .withColumn("derivation", F.coalesce("room.derivation", F.lit("ai-fallback"))).drop("room"))


def fuse_dimension_table(takeoff: DataFrame, table: DataFrame, ceiling_ft: float = 9.0) -> DataFrame:
    """Walls and ceilings from a printed room table.

    ``table``: takeoff_id, ord, label, width_ft, height_ft.  Outdoor rooms are skipped; substrate and
    confidence come from the model's last row of the same room; trim, doors and windows stay for
    listed rooms only.  Takeoffs without a table pass unchanged.
    """
    has = table.select("takeoff_id").distinct()
    key = T.alnum_key(c("room_label"))
    mine = takeoff.join(has, "takeoff_id", "left_semi")
    known = (mine.where(c("type").isin("wall", "ceiling")).groupBy("takeoff_id", "type", key.alias("k"))
             .agg(F.max_by(F.struct("substrate", "confidence"), "ord").alias("ai")))
    kinds = F.explode(F.array(F.lit("wall"), F.lit("ceiling")))
    run = (c("width_ft") + c("height_ft")) * 2
    rows = (table.where(X.is_interior(c("label"))).withColumn("type", kinds)
            .withColumn("k", T.alnum_key(c("label"))).join(known, ["takeoff_id", "type", "k"], "left")
            .select("takeoff_id", c("ord").cast("string").alias("ord"), "type", c("label").alias("room_label"),
                    P.half_up(F.when(c("type") == "wall", run * ceiling_ft).otherwise(c("width_ft") * c("height_ft")),
                              1).alias("area_sqft"),
                    F.when(c("type") == "wall", P.half_up(run, 1)).alias("linear_ft"),
                    F.lit(None).cast("int").alias("count"),
                    F.coalesce("ai.substrate", F.lit("drywall")).alias("substrate"),
                    F.coalesce("ai.confidence", F.lit(0.85)).alias("confidence")))
    listed = table.select("takeoff_id", T.alnum_key(c("label")).alias("k")).distinct()
    rest = (mine.where(~c("type").isin("wall", "ceiling")).withColumn("k", key)
            .join(listed, ["takeoff_id", "k"], "left_semi").drop("k"))
    return (takeoff.join(has, "takeoff_id", "left_anti").unionByName(rest, allowMissingColumns=True)
            .unionByName(rows, allowMissingColumns=True))


def apply_findings(takeoff: DataFrame, findings: DataFrame) -> DataFrame:
    """Reviewer findings on the first row of their kind whose label contains theirs.

    ``findings``: takeoff_id, pos, kind, room_label, severity, suggested_area, suggested_count.
    Later findings overwrite earlier suggestions on the same row.
    """
    asked = findings.where(c("kind") != "missing_room").select(
        "takeoff_id", c("kind").alias("type"), "pos", F.lower("room_label").alias("needle"), "severity",
        "suggested_area", "suggested_count")
    texts = takeoff.select("takeoff_id", "type", F.lower("room_label").alias("hay"), "ord").where(
        c("hay").isNotNull()).groupBy("takeoff_id", "type", "hay").agg(F.min("ord").alias("ord"))
    needles = asked.select("takeoff_id", "type", "needle").distinct().withColumn("_k", F.substring("needle", 1, 3))
    # a text is spread only over the beginnings that some needle of its takeoff and type has
    starts = needles.groupBy("takeoff_id", "type").agg(F.collect_set("_k").alias("_ks"))
    spots = texts.join(starts, ["takeoff_id", "type"]).withColumn("_k", F.explode(F.filter("_ks", lambda k: F.contains(c("hay"), k)))).drop("_ks")
    found = (needles.join(spots, ["takeoff_id", "type", "_k"])
             .where(F.contains(c("hay"), c("needle")))
             .groupBy("takeoff_id", "type", "needle").agg(F.min("ord").alias("ord")))
    high = c("severity") == "high"
    area = F.when(high & (c("suggested_area") > 0), c("suggested_area"))
    count = F.when(high, c("suggested_count"))
    effect = (asked.join(found, ["takeoff_id", "type", "needle"]).groupBy("takeoff_id", "type", "ord").agg(
        F.max_by(area, F.when(area.isNotNull(), c("pos"))).alias("_area"),
        F.max_by(count, F.when(count.isNotNull(), c("pos"))).alias("_count"), F.lit(True).alias("_hit")))
    kind = c("type")
    return (takeoff.join(effect, ["takeoff_id", "type", "ord"], "left")
            .withColumn("confidence", F.when(c("_hit"), F.least("confidence", F.lit(0.5))).otherwise(c("confidence")))
            .withColumn("area_sqft", F.when(kind.isin("wall", "ceiling"), F.coalesce("_area", "area_sqft"))
                        .otherwise(c("area_sqft")))
            .withColumn("count", F.when(kind.isin("door", "window"), F.coalesce("_count", "count"))
                        .otherwise(c("count"))).drop("_area", "_count", "_hit"))


def fuse(takeoff: DataFrame, table: DataFrame, findings: DataFrame, rooms: DataFrame, ceiling_ft: Column) -> DataFrame:
    """The whole order: table, plausibility, findings (not where a table was used), geometry."""
    tabled = fuse_dimension_table(takeoff, table)
    plausible = plausibility(tabled)[1]
    open_findings = findings.join(table.select("takeoff_id").distinct(), "takeoff_id", "left_anti")
    return fuse_geometry(apply_findings(plausible, open_findings), rooms, ceiling_ft)
