"""Priced lines, bid totals, versions and exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from plumbline import refdata as R
from plumbline.functions import pricing as P, text as T

c = F.col


@dataclass(frozen=True)
class BidConfig:
    default_hourly: float = R.DEFAULT_HOURLY
    burden: float = R.BURDEN
    paint_price: float = R.PAINT_PRICE
    flags: tuple[str, ...] = ()


def hourly_rates(rates: DataFrame) -> DataFrame:
    """One row per surface type: the last listed hourly cost wins."""
    return (rates.where(c("hourly_cost").isNotNull()).groupBy(c("surface_type").alias("type"))
            .agg(F.max_by("hourly_cost", "ord").alias("hourly")))


def fallback_rate(rates: DataFrame, default: float = R.DEFAULT_HOURLY) -> DataFrame:
    """A single row: the first ``default`` row's *rate* field, else the built-in value."""
    return (rates.where(c("surface_type") == "default")
            .agg(F.coalesce(F.min_by("rate", "ord"), F.lit(default)).alias("fallback")))


def bid_lines(surfaces: DataFrame, projects: DataFrame, rates: DataFrame,
              cfg: BidConfig = BidConfig()) -> DataFrame:
    """One priced line per billable surface.

    The rate settings collapse to one row per surface type before they are joined; AQE broadcasts that side
    where its measured size allows.
    """
    flags = {name: True for name in cfg.flags}
    priced = (
        surfaces.where(P.billable(c("status"), c("type"), c("finish_type")))
        .join(projects.select("project_id", "measurement_mode", "waste_factor"), "project_id")
        .join(hourly_rates(rates), "type", "left")
        .select(
            "project_id", "surface_id", "type", "room_label", "paint_type", "coats", "substrate", "waste_factor",
            P.unit_for(c("type")).alias("unit"),
            P.quantity(c("type"), c("square_footage"), c("linear_footage"), c("count"),
                       c("measurement_mode")).alias("quantity"),
            P.production_rate(c("type"), **flags).alias("production_rate"),
            F.coalesce(c("hourly"), fallback_rate(rates, cfg.default_hourly).scalar()).alias("hourly"),
            c("square_footage"), c("linear_footage"), c("count")))
    hours = P.labor_hours(c("quantity"), c("coats"), c("production_rate"))
    gal = P.gallons(c("type"), c("quantity"), c("coats"), c("substrate"), c("waste_factor"))
    return (priced.withColumn("labor_hours", hours)
            .withColumn("labor_cost", P.labor_cost(c("labor_hours"), c("hourly"), cfg.burden))
            .withColumn("gallons", gal)
            .withColumn("material_cost", c("gallons") * F.lit(cfg.paint_price))
            .withColumn("needs_measurement", needs_measurement())
            .drop("substrate", "waste_factor", "hourly", "square_footage", "linear_footage", "count"))


def needs_measurement():
    """Nothing to price because the unit's own measurement is absent."""
    own = (F.when(c("unit") == "sqft", c("square_footage")).when(c("unit") == "lf", c("linear_footage"))
           .otherwise(c("count").cast("double")))
    return (c("quantity") == 0) & own.isNull()


def bid_totals(lines: DataFrame, projects: DataFrame) -> DataFrame:
    """Per-project totals; a project without billable lines totals zero."""
    sums = lines.groupBy("project_id").agg(
        F.sum("labor_cost").alias("total_labor"), F.sum("material_cost").alias("total_material"),
        F.count(F.lit(1)).alias("line_count"))
    out = projects.select("project_id", "overhead_pct", "markup").join(sums, "project_id", "left").fillna(
        {"total_labor": 0.0, "total_material": 0.0, "line_count": 0})
    return (out.withColumn("subtotal", c("total_labor") + c("total_material"))
            .withColumn("total_overhead", c("subtotal") * c("overhead_pct"))
            .withColumn("total_markup", (c("subtotal") + c("total_overhead")) * c("markup"))
            .withColumn("grand_total", c("subtotal") + c("total_overhead") + c("total_markup"))
            .drop("overhead_pct", "markup"))


def room_schedule(lines: DataFrame) -> DataFrame:
    """Quantities and cost per room.

    Compatibility: the wall length column exists but is never filled, and wall paths add cost
    without area.
    """
    def qty(kind: str):
        return F.sum(F.when(c("type") == kind, c("quantity")).otherwise(0.0))
    return (lines.groupBy("project_id", F.coalesce("room_label", F.lit("(no room)")).alias("room_label"))
            .agg(qty("wall").alias("wall_sqft"), qty("ceiling").alias("ceiling_sqft"),
                 qty("trim").alias("trim_lf"), qty("door").alias("doors"), qty("window").alias("windows"),
                 F.sum("labor_cost").alias("labor_cost"), F.sum("material_cost").alias("material_cost"))
            .withColumn("wall_lf", F.lit(0.0))
            .withColumn("total_cost", c("labor_cost") + c("material_cost")))


def latest_bid(versions: DataFrame) -> DataFrame:
    """Highest version per project (F1); an aggregate, so a busy project never fills one task."""
    rest = [col for col in versions.columns if col not in ("project_id", "version_number")]
    best = versions.groupBy("project_id").agg(
        F.max("version_number").alias("version_number"),
        F.max_by(F.struct(*rest), "version_number").alias("_row"))
    return best.select("project_id", "version_number", *[c(f"_row.{col}").alias(col) for col in rest])


def append_bid(versions: DataFrame, totals: DataFrame) -> DataFrame:
    """The new version rows: latest number plus one, starting at one (B1)."""
    last = versions.groupBy("project_id").agg(F.max("version_number").alias("_last"))
    return (totals.join(last, "project_id", "left")
            .withColumn("version_number", (F.coalesce("_last", F.lit(0)) + 1).cast("int")).drop("_last"))


def write_bid(lines: DataFrame, new_versions: DataFrame, folder: str) -> None:
    """Append versions and their normalised lines."""
    new_versions.write.mode("append").parquet(f"{folder}/bid_versions")
    (lines.join(new_versions.select("project_id", "version_number"), "project_id")
     .write.mode("append").parquet(f"{folder}/bid_line_items"))


#: fixed values: export headings
CSV_HEADER = ["Room", "Type", "Paint", "Coats", "Quantity", "Unit", "Production rate", "Labor hours",
              "Material cost", "Labor cost"]


def bid_csv(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """The CSV export as ten text columns plus (project_id, ord): header, lines, blank, footer (B2)."""
    names = [f"c{i}" for i in range(10)]

    def constant(values: list) -> list:
        return [F.lit(v).alias(n) for n, v in zip(names, values)]

    header = totals.select("project_id", F.lit(0).alias("part"), F.lit("").alias("ord"), *constant(CSV_HEADER))
    body = lines.select(
        "project_id", F.lit(1).alias("part"), c("surface_id").alias("ord"),
        *[col.alias(n) for n, col in zip(names, [
            F.coalesce("room_label", F.lit("")), c("type"), F.coalesce("paint_type", F.lit("")),
            c("coats").cast("string"), P.half_up(c("quantity")).cast("bigint").cast("string"), c("unit"),
            F.coalesce(T.fixed(c("production_rate"), 2), F.lit("NaN")), T.fixed(c("labor_hours"), 2),
            T.fixed(c("material_cost"), 2), T.fixed(c("labor_cost"), 2)])])
    blank = totals.select("project_id", F.lit(2).alias("part"), F.lit("").alias("ord"), *constant([""] * 10))

    def footer(part: int, name: str, material: str | None, labor: str):
        cells = [F.lit(name)] + [F.lit("")] * 7 + [
            T.fixed(c(material), 2) if material else F.lit(""), T.fixed(c(labor), 2)]
        return totals.select("project_id", F.lit(part).alias("part"), F.lit("").alias("ord"),
                             *[cell.alias(n) for n, cell in zip(names, cells)])

    return (header.unionByName(body).unionByName(blank)
            .unionByName(footer(3, "Subtotal", "total_material", "total_labor"))
            .unionByName(footer(4, "Overhead", None, "total_overhead"))
            .unionByName(footer(5, "Markup", None, "total_markup"))
            .unionByName(footer(6, "Grand total", None, "grand_total")))


def csv_lines(export: DataFrame) -> DataFrame:
    """One text line per export row, fields quoted only where needed."""
    cells = [T.csv_field(c(f"c{i}")) for i in range(10)]
    line = F.when(c("part") == 2, F.lit("")).otherwise(F.concat_ws(",", *cells))
    return export.select("project_id", "part", "ord", line.alias("line"))


def write_bid_csv(export: DataFrame, folder: str) -> None:
    """One folder per project, rows in document order within each file."""
    (csv_lines(export).repartition("project_id").sortWithinPartitions("project_id", "part", "ord")
     .select("project_id", "line").write.mode("overwrite").partitionBy("project_id").text(folder))


def bid_summary(totals: DataFrame, projects: DataFrame, versions: DataFrame, generated: str) -> DataFrame:
    """The fifteen key/value rows of the workbook's first sheet."""
    row = (totals.join(projects, "project_id")
           .join(versions.select("project_id", "version_number"), "project_id"))
    def money(name: str):
        return P.half_up(c(name), 2).cast("string")  # the double's own cents; round() goes by its shortest decimal form
    rows = [
        ("Project", c("name")), ("Client", F.coalesce("client_name", F.lit(""))),
        ("Bid version", c("version_number").cast("string")), ("Generated", F.lit(generated)),
        ("", F.lit("")), ("Total material", money("total_material")), ("Total labor", money("total_labor")),
        ("Total overhead", money("total_overhead")), ("Total markup", money("total_markup")),
        ("Grand total", money("grand_total")), ("", F.lit("")),
        ("Measurement mode", c("measurement_mode")), ("Waste factor", F.round("waste_factor", 4).cast("string")),
        ("Overhead", F.round("overhead_pct", 4).cast("string")), ("Markup", F.round(c("markup"), 4).cast("string"))]
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(k).alias("field"), v.alias("value"))
                      for i, (k, v) in enumerate(rows)])
    return row.select("project_id", F.inline(pairs))


def symbol_sheet(surfaces: DataFrame) -> DataFrame:
    return surfaces.where(c("type").startswith("symbol:")).select(
        "project_id", "surface_id", T.symbol_name(c("type")).alias("type"),
        F.coalesce("room_label", F.lit("")).alias("room"),
        F.coalesce("count", F.lit(0)).alias("count"), "confidence")


def line_sheet(lines: DataFrame) -> DataFrame:
    return lines.select(
        "project_id", "surface_id", F.coalesce("room_label", F.lit("")).alias("room"), "type",
        F.coalesce("paint_type", F.lit("")).alias("paint"), "coats", "quantity", "unit", "production_rate",
        "labor_hours", "labor_cost", "gallons", "material_cost")


def write_workbook(sheets: dict[str, DataFrame], folder: str) -> None:
    """One sub-folder per sheet."""
    for name, sheet in sheets.items():
        sheet.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def reprice(surfaces: DataFrame, projects: DataFrame, rates: DataFrame, overrides: DataFrame,
            cfg: BidConfig = BidConfig()) -> DataFrame:
    """Bid totals with some quantities replaced (K10); ``overrides`` = surface_id, quantity.

    An override is a finished line quantity, so area overrides are divided by the mode factor that
    pricing applies again.  Other lines keep their measured values; re-applying the factor to every
    line on each edit, as an interactive sheet would, is deliberately not reproduced.
    """
    unit = P.unit_for(c("type"))
    given = c("_new").isNotNull()
    factor = P.mode_factor(c("measurement_mode"))
    edited = (
        surfaces.join(overrides.select("surface_id", c("quantity").alias("_new")), "surface_id", "left")
        .join(projects.select("project_id", "measurement_mode"), "project_id")
        .withColumn("square_footage", F.when(given & (unit == "sqft"), c("_new") / factor)
                    .otherwise(c("square_footage")))
        .withColumn("linear_footage", F.when(given & (unit == "lf"), c("_new")).otherwise(c("linear_footage")))
        .withColumn("count", F.when(given & (unit == "ea"), c("_new")).otherwise(c("count").cast("double")))
        .drop("_new", "measurement_mode"))
    return bid_totals(bid_lines(edited, projects, rates, cfg), projects)
