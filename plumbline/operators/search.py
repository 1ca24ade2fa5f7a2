"""Filtered scans, quantities, symbol counts, dashboards and top-k reports (A, C3-C6, C19, C22, E6-E13, G1-G3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline import refdata as R
from plumbline.functions import pricing as P, text as T

c = F.col
BULK_THRESHOLD = 10


def scan(df: DataFrame, **keys) -> DataFrame:
    """Equality scan on the given columns; the predicates reach the file reader (A1)."""
    for name, value in keys.items():
        if value is not None:
            df = df.where(c(name) == value)
    return df


def scan_surfaces(surfaces: DataFrame, project_id: str | None = None, plan_page_id: str | None = None) -> DataFrame:
    """Surfaces of a project and/or page; at least one of them is required (A2)."""
    if project_id is None and plan_page_id is None:
        raise ValueError("give a project or a page")
    return scan(surfaces, project_id=project_id, plan_page_id=plan_page_id)


def project_list(projects: DataFrame) -> DataFrame:
    """Newest update first."""
    return projects.orderBy(F.desc("updated_epoch"))


def project_pages(projects: DataFrame, pages: DataFrame) -> DataFrame:
    """Projects with their pages, one row per page."""
    return projects.select("project_id", "name").join(pages, "project_id", "left")


def transcript(messages: DataFrame) -> DataFrame:
    """The visible part of a conversation."""
    return messages.where(c("role").isin("user", "assistant"))


def expand_pages(plans: DataFrame) -> DataFrame:
    """One row per page 1..page_count (A5)."""
    return plans.withColumn("page_number", F.explode(F.sequence(F.lit(1), c("page_count"))))


# --- filters -----------------------------------------------------------------------------------
@dataclass(frozen=True)
class ToolFilter:
    surface_type: str | None = None
    paint_type: str | None = None
    rooms: str | None = None


def tool_filter(f: ToolFilter | None) -> Column:
    """Type, paint and any of the ``|``-separated room words; excluded rows are included."""
    cond = F.lit(True)
    if f and f.surface_type:
        cond = cond & (c("type") == f.surface_type)
    if f and f.paint_type:
        cond = cond & (c("paint_type") == f.paint_type)
    rooms = T.like_any(c("room_label"), f.rooms) if f and f.rooms else None
    return cond if rooms is None else cond & rooms


@dataclass(frozen=True)
class SearchQuery:
    rooms: str | None = None
    surface_type: str | None = None
    paint_type: str | None = None
    substrate: str | None = None
    symbol_type: str | None = None


def search_filter(q: SearchQuery) -> Column:
    """Equality on the given fields plus a case-insensitive regular expression on the room (C4)."""
    kind = f"symbol:{q.symbol_type}" if q.symbol_type else q.surface_type
    cond = F.lit(True)
    for name, value in (("type", kind), ("paint_type", q.paint_type), ("substrate", q.substrate)):
        if value:
            cond = cond & (c(name) == value)
    return cond & c("room_label").rlike("(?i)" + q.rooms) if q.rooms else cond


def first_per_group(df: DataFrame, group: str | list[str], order: list, n: int) -> DataFrame:
    """The first n rows of every group; Spark limits each partition's groups before the shuffle."""
    keys = [group] if isinstance(group, str) else group
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(c("rank") <= n)


def search(surfaces: DataFrame, q: SearchQuery, n: int = 10) -> DataFrame:
    """A sample of n hits per project with the full hit count."""
    hits = surfaces.where(search_filter(q))
    counts = hits.groupBy("project_id").agg(F.count(F.lit(1)).alias("hits"))
    return first_per_group(hits, "project_id", [c("surface_id")], n).join(counts, "project_id")


def query_quantities(surfaces: DataFrame, f: ToolFilter | None = None) -> DataFrame:
    """Row count and sums behind a filter (E11); missing measurements count as zero."""
    return (surfaces.where(tool_filter(f)).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("surface_count"),
        F.sum(F.coalesce("square_footage", F.lit(0.0))).alias("square_footage"),
        F.sum(F.coalesce("linear_footage", F.lit(0.0))).alias("linear_footage"),
        F.sum(F.coalesce("count", F.lit(0))).cast("bigint").alias("item_count")))


def preview(surfaces: DataFrame, f: ToolFilter | None, threshold: int = BULK_THRESHOLD) -> DataFrame:
    """How many rows an edit would touch and whether it needs confirmation."""
    return (surfaces.where(tool_filter(f)).groupBy("project_id").agg(F.count(F.lit(1)).alias("affected"))
            .withColumn("needs_confirmation", c("affected") > threshold))


# --- pages ---------------------------------------------------------------------------------------
def eligible_pages(pages: DataFrame) -> DataFrame:
    return pages.where(c("page_type").isin(R.TAKEOFF_PAGE_TYPES) & ~c("hidden"))


def first_eligible_page(pages: DataFrame) -> DataFrame:
    """First page by number that can be measured."""
    return eligible_pages(pages).groupBy("project_id").agg(
        F.min_by("plan_page_id", F.struct("page_number", "plan_page_id")).alias("plan_page_id"),
        F.min("page_number").alias("page_number"))


def pages_to_classify(pages: DataFrame, force: bool = False) -> DataFrame:
    return pages if force else pages.where(c("page_type").isNull())


def page_rail(pages: DataFrame) -> DataFrame:
    """Rail group of every page."""
    group = (F.when(c("hidden"), "hidden").when(c("page_type").isin(R.TAKEOFF_PAGE_TYPES), "floor")
             .when(c("page_type").isNull(), "unclassified").otherwise("other"))
    return pages.withColumn("rail", group)


def known_values(surfaces: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed non-empty values in use per project."""
    value = F.trim(c(column))
    return surfaces.where(value != "").select("project_id", value.alias(column)).distinct()


# --- counts ----------------------------------------------------------------------------------------
def symbol_rooms(surfaces: DataFrame, symbol: str | None = None) -> DataFrame:
    """Counts by room with a total row (room_label NULL) for every project and symbol."""
    kind = c("type") == f"symbol:{symbol}" if symbol else c("type").startswith("symbol:")
    return (surfaces.where(kind)
            .select("project_id", T.symbol_name(c("type")).alias("symbol"),
                    F.coalesce("room_label", F.lit("(no room)")).alias("room_label"),
                    F.coalesce("count", F.lit(0)).alias("n"))
            .groupingSets([["project_id", "symbol", "room_label"], ["project_id", "symbol"]],
                          "project_id", "symbol", "room_label").agg(F.sum("n").alias("total")))


def symbol_category(symbol: Column, fallback: str = "furniture") -> Column:
    return P.lookup(symbol, {s: cat for cat, names in R.SYMBOLS.items() for s in names}, fallback)


def symbol_counts(surfaces: DataFrame) -> DataFrame:
    """Totals by symbol with its panel category and the category's position."""
    panel = {s: R.PANEL_CATEGORY[cat] for cat, names in R.SYMBOLS.items() if cat in R.PANEL_CATEGORY
             for s in names}
    name = T.symbol_name(c("type"))
    counted = (surfaces.where(c("type").startswith("symbol:"))
               .groupBy("project_id", name.alias("symbol"))
               .agg(F.sum(F.coalesce("count", F.lit(0))).cast("bigint").alias("total")))
    order = {cat: i for i, cat in enumerate(R.PANEL_ORDER)}
    return (counted.withColumn("category", P.lookup(c("symbol"), panel, "Other"))
            .withColumn("category_order", P.lookup(c("category"), order))
            .withColumn("title", T.pretty_symbol(c("symbol"))))


def category_totals(surfaces: DataFrame) -> DataFrame:
    return (surfaces.where(c("type").startswith("symbol:"))
            .groupBy("project_id", symbol_category(T.symbol_name(c("type"))).alias("category"))
            .agg(F.sum(F.coalesce("count", F.lit(0))).cast("bigint").alias("total")))


def type_counts(surfaces: DataFrame) -> DataFrame:
    """Non-excluded rows by type."""
    return surfaces.where(c("status") != "excluded").groupBy("project_id", "type").agg(
        F.count(F.lit(1)).alias("surfaces"))


def dashboard(projects: DataFrame, pages: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Page and surface counts per project, each counted before the join."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("project_id").agg(F.count(F.lit(1)).alias(name))
    return (projects.select("project_id", "name").join(counts(pages, "pages"), "project_id", "left")
            .join(counts(surfaces, "surfaces"), "project_id", "left").fillna(0, ["pages", "surfaces"]))


def recent_audit(audit: DataFrame, n: int = 100) -> DataFrame:
    """The latest n entries per project and whether they can be undone (G1)."""
    return (first_per_group(audit, "project_id", [F.desc("created_at"), F.desc("audit_id")], n)
            .withColumn("undoable", c("before").isNotNull()))


def chat_history(messages: DataFrame, n: int = 30, latest: bool = False) -> DataFrame:
    """The oldest n messages of a conversation.

    Compatibility: the oldest ones are taken although the latest look intended; ``latest=True``
    gives those.
    """
    order = [F.desc("turn")] if latest else [c("turn")]
    return first_per_group(messages, "conv_id", order, n)


def claims_summary(takeoff: DataFrame) -> DataFrame:
    """One text line per room stating what a takeoff claims."""
    def total(kind: str, column: str) -> Column:
        return F.sum(F.when(c("type") == kind, F.coalesce(c(column).cast("double"), F.lit(0.0))).otherwise(0.0))
    rooms = takeoff.groupBy("takeoff_id", "room_label").agg(
        total("wall", "area_sqft").alias("ws"), total("wall", "linear_ft").alias("wl"),
        total("ceiling", "area_sqft").alias("cs"), total("trim", "linear_ft").alias("tl"),
        total("door", "count").alias("d"), total("window", "count").alias("w"))
    line = F.concat(c("room_label"), F.lit(": walls="), T.whole(c("ws")), F.lit(" sqft (perimeter "),
                    T.whole(c("wl")), F.lit(" lf), ceil="), T.whole(c("cs")), F.lit(" sqft, trim="),
                    T.whole(c("tl")), F.lit(" lf, doors="), T.whole(c("d")), F.lit(", windows="), T.whole(c("w")))
    return rooms.select("takeoff_id", "room_label", line.alias("claim"))


#: fixed values: scope exclusions offered on a proposal
EXCLUSIONS = [
    ("removal-finishes", "Removal of existing finishes"), ("lead-asbestos", "Lead or asbestos abatement"),
    ("wall-covering", "Wall covering / wallpaper"), ("epoxy-floors", "Epoxy or specialty floor coatings"),
    ("exterior-staining", "Exterior staining of structural wood"),
    ("fire-protection", "Fire-protective intumescent coatings"),
]


def scope_text(chosen: Column) -> Column:
    """Labels of the chosen exclusion ids in listed order, lower case."""
    labels = F.array(*[F.when(F.array_contains(chosen, key), F.lit(label.lower())) for key, label in EXCLUSIONS])
    return F.array_join(F.filter(labels, lambda x: x.isNotNull()), ", ")


# --- commands (S41) --------------------------------------------------------------------------------
def parse_command(text: Column) -> Column:
    """Tool, filters and value that a plain-language command stands for."""
    msg = F.lower(text)

    def first(words: list[str]) -> Column:
        found = F.regexp_extract(msg, r"\b(" + "|".join(words) + r")s?\b", 1)
        return F.when(found != "", found)

    room, kind = first(R.COMMAND_ROOMS), first(R.COMMAND_SURFACES)
    paint = F.coalesce(*[F.when(msg.contains(p), F.lit(p)) for p in R.COMMAND_PAINTS])
    edit = (msg.contains("change") | msg.contains("update") | msg.contains("set")) & paint.isNotNull()
    total = msg.contains("total") & (msg.contains("square") | msg.contains("sqft") | msg.contains("footage"))
    tool = (F.when(edit, "update_surfaces").when(total, "query_quantities")
            .when(msg.contains("exclude"), "exclude_surfaces")
            .when(msg.rlike(r"\bwaste\b"), "set_waste_factor").when(msg.rlike(r"\bmarkup\b"), "set_markup"))
    pct = F.when(tool.isin("set_waste_factor", "set_markup"), T.percentage(msg))
    on_rows = tool.isin("update_surfaces", "query_quantities", "exclude_surfaces")
    return F.struct(
        tool.alias("tool"), F.when(on_rows, T.capitalised(room)).alias("rooms"),
        F.when(tool.isin("update_surfaces", "exclude_surfaces"), kind).alias("surface_type"),
        F.when(tool == "update_surfaces", paint).alias("paint_type"), pct.alias("percentage"))
