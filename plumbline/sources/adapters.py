"""Deterministic projections of the given star-schema tables onto the takeoff domain.

``Tables`` is the one place that knows file names; operators only ever see domain DataFrames.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

c = F.col


def _s(col: Column) -> Column:
    return col.cast("string")


def _pick(key: Column, values: list[str | None]) -> Column:
    """The key-th value of a short list."""
    expr = F.when(key == 0, F.lit(values[0]))
    for i, value in enumerate(values[1:], 1):
        expr = expr.when(key == i, F.lit(value))
    return expr


PAGE_TYPES = ["floor_plan", "rcp", "elevation", "schedule", None, "floor_plan", "detail"]
ROOM_WORDS = ["OFFICE", "BEDROOM", "KITCHEN", "CORRIDOR", "LOBBY", "BATH", "STORAGE", "CLOSET"]
MODELS = ["claude-sonnet-4-5", "claude-haiku-4-5", "house-model"]

#: labor-rate settings: a duplicate (last row wins) and a literal ``default`` row
RATES = [
    (0, "wall", "sqft", 175.0, 58.0), (1, "ceiling", "sqft", 135.0, 62.0), (2, "trim", "lf", 60.0, 52.0),
    (3, "door", "ea", 3.6, 48.0), (4, "window", "ea", 6.0, 50.0), (5, "wall", "sqft", 175.0, 60.0),
    (6, "default", "sqft", 57.0, None),
]


def constant_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few literal rows as a local relation: no Python worker is started to read them."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    row = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*row)))


class Tables:
    """Lazily built domain tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- estimating -------------------------------------------------------------------------
    @cached_property
    def surfaces(self) -> DataFrame:
        line, orders, part = self.raw("lineitem"), self.raw("orders"), self.raw("part")
        n, sup = c("l_linenumber"), c("l_suppkey")
        kind = (F.when(n == 1, "wall").when(n == 2, "ceiling").when(n == 3, "trim").when(n == 4, "door")
                .when(n == 5, "window").when(n == 6, "wall-path")
                .when(sup % 3 == 0, "symbol:toilet").when(sup % 3 == 1, "symbol:single_door")
                .otherwise("annotation:note"))
        loud = F.concat(F.lit("  "), F.replace(F.upper(c("p_name")), F.lit(" "), F.lit("  ")))
        room = (F.when(sup % 11 == 0, F.lit(None)).when(c("l_partkey") % 2 == 0, c("p_name")).otherwise(loud))
        status = (F.when(c("l_returnflag") == "R", "excluded").when(c("l_returnflag") == "A", "accepted")
                  .when(c("l_linestatus") == "O", "proposed").otherwise("manual"))
        qty = c("l_quantity")
        return (
            line.join(orders.select("o_orderkey", "o_custkey"), line.l_orderkey == orders.o_orderkey)
            .join(part.select("p_partkey", "p_name", "p_brand", "p_size"), line.l_partkey == part.p_partkey)
            .select(
                F.concat_ws("-", _s(c("l_orderkey")), _s(n), _s(c("l_partkey")), _s(sup),
                            _s(qty.cast("bigint")),
                            _s(F.round(c("l_extendedprice") * 100).cast("bigint"))).alias("surface_id"),
                _s(c("o_custkey")).alias("project_id"),
                _s(c("l_orderkey")).alias("plan_page_id"),
                kind.alias("type"),
                room.alias("room_label"),
                (c("p_size") % 3 + 1).cast("int").alias("coats"),
                c("p_brand").alias("paint_type"),
                _pick(c("l_partkey") % 6, ["CMU", "Drywall heavy texture", "wood", "metal", None,
                                           "drywall"]).alias("substrate"),
                F.when(n.isin(1, 2, 6) & (sup % 13 != 0), qty * 10).alias("square_footage"),
                F.when(n.isin(1, 3, 6), qty + 5).alias("linear_footage"),
                F.when(n.isin(4, 5, 7) & (sup % 7 != 0), F.floor(qty / 10).cast("int")).alias("count"),
                (F.lit(0.5) + c("l_discount") * 5).alias("confidence"),
                status.alias("status"),
                F.when(n == 6, _pick(sup % 4, ["tile", None, "paint", "paint"])).alias("finish_type"),
                F.when(sup % 2 == 0, "ai").otherwise("manual").alias("source"),
                F.when(c("l_linestatus") == "F", "old").otherwise("new").alias("revision"),
                c("l_shipdate").cast("timestamp_ntz").alias("created_at"),
            ))

    @cached_property
    def projects(self) -> DataFrame:
        k = c("c_custkey")
        return self.raw("customer").select(
            _s(k).alias("project_id"), c("c_name").alias("name"),
            F.when(k % 5 != 0, c("c_mktsegment")).alias("client_name"),
            F.when(k % 3 == 0, "draft").otherwise("sent").alias("status"),
            _pick(k % 3, ["net", "gross", "pca"]).alias("measurement_mode"),
            (F.lit(0.10) + (k % 2) * 0.05).alias("waste_factor"),
            (F.lit(0.20) + (k % 4) * 0.05).alias("markup"),
            F.lit(0.10).alias("overhead_pct"),
            (F.lit(8.0) + k % 5).alias("ceiling_height_ft"),
            (k * 3600 + 1704067200).alias("updated_epoch"))

    @cached_property
    def rates(self) -> DataFrame:
        return constant_rows(
            self.spark, RATES, "ord int, surface_type string, unit string, rate double, hourly_cost double")

    @cached_property
    def plan_pages(self) -> DataFrame:
        k = c("o_orderkey")
        return self.raw("orders").select(
            _s(k).alias("plan_page_id"), _s(c("o_custkey")).alias("project_id"),
            (k % 9 + 1).cast("int").alias("page_number"),
            _pick(k % 7, PAGE_TYPES).alias("page_type"), (k % 13 == 0).alias("hidden"))

    @cached_property
    def bid_versions(self) -> DataFrame:
        """A price history per project, from all orders."""
        total = c("o_totalprice")
        return self.raw("orders").groupBy(
            _s(c("o_custkey")).alias("project_id"), (c("o_orderkey") % 9 + 1).cast("int").alias("version_number")
        ).agg(F.max(total).alias("grand_total"))

    # --- metering ---------------------------------------------------------------------------
    @cached_property
    def api_usage(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", "user_id", c("event_type").alias("endpoint"),
            _pick(c("user_id") % 3, MODELS).alias("model"),
            F.floor(c("value") * 100).cast("bigint").alias("input_tokens"),
            F.floor(c("value") * 10).cast("bigint").alias("output_tokens"),
            F.when(c("event_id") % 4 == 0, F.floor(c("value") * 50).cast("bigint")).alias("cache_read"),
            F.when(c("event_id") % 5 == 0, F.floor(c("value") * 20).cast("bigint")).alias("cache_write"),
            c("ts").cast("timestamp_ntz").alias("created_at"))

    @cached_property
    def requests(self) -> DataFrame:
        """Limiter requests: one row per event, time as whole microseconds since the epoch."""
        micros = F.unix_micros(c("ts").cast("timestamp"))
        return self.raw("events").select("event_id", _s(c("user_id")).alias("key"), micros.alias("at_us"))

    @cached_property
    def messages(self) -> DataFrame:
        return self.raw("conversations").select("conv_id", "turn", "role", "text")

    # --- plan text and geometry ---------------------------------------------------------------
    @cached_property
    def fragments(self) -> DataFrame:
        """Text fragments of a page: 40 parts make a page laid out on an 8 x 5 lattice."""
        k = c("p_partkey")
        slot, page = k % 40, F.floor(k / 40)
        inch = k % 12
        feet_in = F.concat(_s(c("p_size")), F.lit("'-"), _s(inch), F.lit('"'))
        by = F.concat(_s(c("p_size")), F.lit("'"), _s(inch), F.lit('" x '), _s(c("p_size") % 17 + 4), F.lit("'"),
                      _s((inch + 5) % 12), F.lit('"'))
        text = (F.when(k % 10 == 0, F.concat(F.upper(c("p_name")), F.lit(" "), _pick(c("p_size") % 8, ROOM_WORDS)))
                .when(k % 10 == 1, feet_in)
                .when(k % 10 == 2, by)
                .when((k % 10 == 3) & (k % 40 < 20), F.lit("SCALE"))
                .when((k % 10 == 4) & (k % 40 < 20), _pick(k % 3, ['1/4" = 1\'-0"', '1/8"=1\'', "1:100"]))
                .when(k % 10 == 5, F.concat(_s(c("p_size") % 40), F.lit('"')))
                .when(k % 10 == 6, F.concat(_s(c("p_size")), F.lit("'-"), _s(inch), F.lit(' 1/2"')))
                .when(k % 10 == 7, _pick(c("p_size") % 4, ["01/02/2024", "REVISIONS", "DRAWN BY", "A-101"]))
                .when(k % 10 == 8, F.concat(_s(c("p_size")), F.lit("'")))
                .otherwise(c("p_name")))
        return self.raw("part").select(
            _s(page).alias("page_id"), slot.cast("int").alias("seq"), text.alias("text"),
            (F.lit(60.0) + (slot % 8) * 130 + c("p_size") % 7).alias("x"),
            (F.lit(700.0) - F.floor(slot / 8) * 130 - c("p_size") % 5).alias("y"),
            (F.lit(20.0) + c("p_size") % 30).alias("width"),
            (F.lit(6.0) + c("p_size") % 9).alias("height"),
            _pick(c("p_size") % 4, ["0", "1.5708", "0.1", "3.1416"]).cast("double").alias("rotation"),
            F.lit(1224.0).alias("page_w"), F.lit(792.0).alias("page_h"))

    @cached_property
    def cells(self) -> DataFrame:
        """One rectangular room per order, 12 to a page on a 4 x 3 lattice with ragged gaps."""
        k = c("o_orderkey")
        slot = k % 12
        w, h = F.lit(100.0) + (F.floor(k / 12) % 5) * 20, F.lit(90.0) + (F.floor(k / 12) % 3) * 30
        return self.raw("orders").select(
            _s(F.floor(k / 12)).alias("page_id"), k.cast("bigint").alias("cell_id"),
            (F.lit(40.0) + (slot % 4) * w).alias("x1"), (F.lit(50.0) + F.floor(slot / 4) * h).alias("y1"),
            (F.lit(40.0) + (slot % 4 + 1) * w).alias("x2"), (F.lit(50.0) + (F.floor(slot / 4) + 1) * h).alias("y2"),
            c("o_custkey").cast("bigint").alias("tag"))

    @cached_property
    def segments(self) -> DataFrame:
        """The four walls of every cell; neighbours repeat their shared wall."""
        side = F.explode(F.array(
            F.struct(c("x1"), c("y1"), c("x2"), c("y1").alias("y2"), F.lit(0).alias("side")),
            F.struct(c("x2").alias("x1"), c("y1"), c("x2"), c("y2"), F.lit(1).alias("side")),
            F.struct(c("x1"), c("y2").alias("y1"), c("x2"), c("y2"), F.lit(2).alias("side")),
            F.struct(c("x1"), c("y1"), c("x1").alias("x2"), c("y2"), F.lit(3).alias("side"))))
        return (self.cells.select("page_id", "cell_id", "tag", side.alias("s"))
                .select("page_id", (c("cell_id") * 4 + c("s.side")).alias("seg_id"), "tag", "s.side",
                        c("s.x1").alias("x1"), c("s.y1").alias("y1"), c("s.x2").alias("x2"),
                        c("s.y2").alias("y2")))
