"""Golden bid of five stub surfaces, pricing quirks, exports and edits."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import pricing as P, text as T
from plumbline.operators import edits, pricing as op
from plumbline.operators.search import ToolFilter, parse_command

SURFACE = ("surface_id string, project_id string, plan_page_id string, type string, room_label string, coats int, paint_type string, substrate string, "
           "square_footage double, linear_footage double, count int, confidence double, status string, finish_type string, source string")


def surface(i, kind, **kw):
    base = dict(surface_id=str(i), project_id="p", plan_page_id="g", type=kind, room_label="Lobby", coats=2, paint_type=None, substrate="drywall",
                square_footage=None, linear_footage=None, count=None, confidence=0.9, status="proposed", finish_type=None, source="ai")
    return tuple({**base, **kw}.values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SURFACE)


def project(spark, mode="net"):
    return spark.createDataFrame([("p", "Job", mode, 0.10, 0.20, 0.10, 9.0)],
                                 "project_id string, name string, measurement_mode string, waste_factor double, markup double, overhead_pct double, ceiling_height_ft double")


def rates(spark, *rows):
    return spark.createDataFrame(list(rows), "ord int, surface_type string, unit string, rate double, hourly_cost double")


STUB = [surface(1, "wall", square_footage=220.0), surface(2, "wall", square_footage=240.0), surface(3, "ceiling", square_footage=480.0),
        surface(4, "trim", linear_footage=64.0), surface(5, "door", count=1)]


def test_golden_bid(spark):
    lines = op.bid_lines(frame(spark, *STUB), project(spark), rates(spark))
    rows = {r.surface_id: r for r in lines.collect()}
    expected = {"1": (2.514286, 179.7714, 1.382857, 62.2286), "2": (2.742857, 196.1143, 1.508571, 67.8857),
                "3": (7.111111, 508.4444, 3.017143, 135.7714), "4": (2.133333, 152.5333, 0.563200, 25.3440),
                "5": (0.555556, 39.7222, 0.550000, 24.7500)}
    for key, (hours, labor, gallons, material) in expected.items():
        r = rows[key]
        assert (r.labor_hours, r.gallons) == pytest.approx((hours, gallons), abs=1e-6)
        assert (r.labor_cost, r.material_cost) == pytest.approx((labor, material), abs=1e-4)
    total = op.bid_totals(lines, project(spark)).first()
    assert (total.total_labor, total.total_material, total.subtotal, total.total_overhead, total.total_markup, total.grand_total) == pytest.approx(
        (1076.5857, 315.9797, 1392.5654, 139.2565, 306.3644, 1838.1864), abs=1e-4)


def test_billable_scope_and_unknown_type(spark):
    rows = [surface(1, "wall", status="excluded"), surface(2, "symbol:toilet"), surface(3, "annotation:note"), surface(4, "wall-path", finish_type="tile"),
            surface(5, "wall-path", square_footage=10.0), surface(6, "mural", square_footage=10.0), surface(7, "door")]
    got = {r.surface_id: r for r in op.bid_lines(frame(spark, *rows), project(spark), rates(spark)).collect()}
    assert sorted(got) == ["5", "6", "7"]
    assert got["6"].labor_hours == 0 and got["6"].unit == "sqft" and got["6"].material_cost > 0
    assert got["7"].quantity == 1


def test_last_rate_wins_and_default_row(spark):
    table = rates(spark, (0, "wall", "sqft", 1.0, 50.0), (1, "wall", "sqft", 1.0, 70.0), (2, "default", "sqft", 40.0, 99.0))
    got = {r.type: r.labor_cost / r.labor_hours / 1.3 for r in op.bid_lines(frame(spark, *STUB), project(spark), table).collect()}
    assert got["wall"] == pytest.approx(70) and got["ceiling"] == pytest.approx(40)


def test_mode_factor_and_reprice_is_stable(spark):
    gross = project(spark, "gross")
    lines = op.bid_lines(frame(spark, *STUB), gross, rates(spark))
    over = lines.select("surface_id", "quantity")
    before, after = op.bid_totals(lines, gross).first(), op.reprice(frame(spark, *STUB), gross, rates(spark), over).first()
    assert after.grand_total == pytest.approx(before.grand_total)
    assert {r.surface_id: r.quantity for r in lines.collect()}["1"] == pytest.approx(231.0)


def test_csv_lines(spark):
    lines = op.bid_lines(frame(spark, surface(1, "wall", square_footage=10.5, room_label='A "B", C')), project(spark), rates(spark))
    text = [r.line for r in op.csv_lines(op.bid_csv(lines, op.bid_totals(lines, project(spark)))).orderBy("part", "ord").collect()]
    assert text[0] == "Room,Type,Paint,Coats,Quantity,Unit,Production rate,Labor hours,Material cost,Labor cost"
    assert text[1].startswith('"A ""B"", C",wall,,2,11,sqft,175.00,0.12,')
    assert text[2] == "" and text[3].startswith("Subtotal,,,,,,,,") and len(text) == 7


def test_half_up_and_coverage(spark):
    row = spark.range(1).select(P.half_up(F.lit(-2.5)).alias("a"), P.half_up(F.lit(0.25), 1).alias("b"), P.coverage(F.lit("Drywall heavy texture")).alias("c"),
                                P.coverage(F.lit("painted CMU block")).alias("d"), P.coverage(F.lit(None).cast("string")).alias("e")).first()
    assert row == (-2.0, 0.3, 350 / 1.2, 350 / 1.3, 350.0)


def test_edit_then_undo_restores(spark):
    df = frame(spark, *STUB)
    steps = [edits.Edit(ToolFilter(surface_type="wall"), paint_type="Satin", coats=3), edits.exclude(ToolFilter(rooms="lob"))]
    state, log = edits.apply_edits(df, steps)
    assert {r.status for r in state.collect()} == {"excluded"} and log.count() == 7
    first = log.groupBy("project_id", "surface_id").agg(F.min_by(F.struct("paint_type", "coats", "substrate", "status"), "edit_no").alias("b"))
    audit = first.select(F.col("surface_id").alias("audit_id"), "project_id", F.lit("x").alias("action"), F.to_json(F.struct(
        F.col("surface_id").alias("id"), F.col("b.paint_type").alias("paintType"), "b.coats", "b.substrate", "b.status"),
        {"ignoreNullFields": "false"}).alias("before"))
    back, _, undo_log = edits.undo(state, project(spark), audit)
    assert sorted(back.select(df.columns).collect()) == sorted(df.collect())
    assert undo_log.count() == 5


def test_unreadable_snapshot_changes_nothing(spark):
    audit = spark.createDataFrame([("a", "p", "x", "not json")], "audit_id string, project_id string, action string, before string")
    back, _, _ = edits.undo(frame(spark, *STUB), project(spark), audit)
    assert sorted(back.collect()) == sorted(frame(spark, *STUB).select(back.columns).collect())


def test_split_then_merge_keeps_area(spark):
    df = frame(spark, surface(1, "wall", square_footage=101.3, linear_footage=11.0))
    halves = edits.split_surfaces(df, spark.createDataFrame([("1", 3.0, 1.0)], "surface_id string, area_a double, area_b double"))
    assert sorted(r.square_footage for r in halves.collect()) == pytest.approx([25.3, 76.0])
    groups = halves.select("surface_id", F.lit("m").alias("merge_id"))
    merged, state = edits.merge_surfaces(halves, groups)
    assert merged.first().square_footage == pytest.approx(101.3, abs=0.1) and state.count() == 1


def test_merge_refuses_mixed_types(spark):
    df = frame(spark, surface(1, "wall"), surface(2, "ceiling"))
    merged, state = edits.merge_surfaces(df, df.select("surface_id", F.lit("m").alias("merge_id")))
    assert merged.count() == 0 and state.count() == 2


def test_members_merge_like_listed_groups(spark):
    df = frame(spark, surface(1, "wall", square_footage=1.0, room_label=None), surface(2, "wall", square_footage=2.0), surface(3, "wall"),
               surface(4, "ceiling"), surface(5, "door", count=2), surface(6, "trim"))
    asked = df.withColumn("merge_id", F.when(F.col("type") == "wall", "w").when(F.col("type") != "trim", "mixed"))
    groups = asked.where("merge_id IS NOT NULL").select("surface_id", "merge_id")
    rooms = F.min_by("room_label", F.when(F.col("room_label").isNotNull(), F.col("surface_id")))
    merged, state = edits.merge_members(asked, any_room=rooms)
    listed, after = edits.merge_surfaces(df, groups)
    assert merged.select(listed.columns).collect() == listed.collect() and merged.first().any_room == df.where("surface_id = '2'").first().room_label
    assert sorted(map(str, state.select(after.columns).collect())) == sorted(map(str, after.collect())) and state.columns == after.columns


def test_carried_changes_are_audited_like_listed_ones(spark):
    df = frame(spark, surface(1, "wall"), surface(2, "door", room_label=None), surface(3, "trim", paint_type=None))
    new = [F.when(F.col("type") == "wall", "Matte").alias("paint_type"), F.when(F.col("type") == "door", 3).alias("coats")]
    carried = edits.changed_audit(df.withColumn("new", F.struct(*new)))
    listed = edits.single_audit(df, df.select("surface_id", *new))
    assert sorted(carried.collect()) == sorted(listed.select(carried.columns).collect()) and carried.count() == 3


@pytest.mark.parametrize("name", ["merge_surfaces", "merge_state", "single_edit_audit"])
def test_ids_made_from_the_row_itself_meet_no_second_scan(spark, name):
    from plumbline.plans import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "surface_id" in x]


@pytest.mark.parametrize("text,tool,rooms,kind,paint,pct", [
    ("Change all bathroom walls to semi-gloss", "update_surfaces", "Bathroom", "wall", "semi-gloss", None),
    ("exclude hallways", "exclude_surfaces", "Hallway", None, None, None),
    ("total square footage in the lobby", "query_quantities", "Lobby", None, None, None),
    ("waste 12.5%", "set_waste_factor", None, None, None, 12.5),
    ("markup of 300 percent", "set_markup", None, None, None, 100.0),
    ("waste 0.12", "set_waste_factor", None, None, None, 12.0),
    ("waste .12", "set_waste_factor", None, None, None, None),  # a bare point does not start a word
    ("set markup to 25", "set_markup", None, None, None, None),
    ("hello", None, None, None, None, None)])
def test_commands(spark, text, tool, rooms, kind, paint, pct):
    row = spark.range(1).select(parse_command(F.lit(text)).alias("p")).first().p
    assert tuple(row) == (tool, rooms, kind, paint, pct)


def test_synonyms_and_names(spark):
    assert T.expand_rooms("Office|x") == "Office|workstation|study|x"
    row = spark.range(1).select(T.pretty_symbol(F.lit("ada_door")), T.limiter_name(F.lit("chat:7")), T.room_key(F.lit("  A  b\tC "))).first()
    assert tuple(row) == ("Ada Door", "chat messages on this project", "a b c")


def test_writers_round_trip(spark, tmp_path):
    df, owner = frame(spark, *STUB), project(spark).withColumn("client_name", F.lit(None).cast("string"))
    lines = op.bid_lines(df, owner, rates(spark))
    totals = op.bid_totals(lines, owner)
    old = spark.createDataFrame([("p", 3, 1.0)], "project_id string, version_number int, grand_total double")
    new = op.append_bid(old, totals)
    op.write_bid(lines, new, str(tmp_path / "bids"))
    assert spark.read.parquet(str(tmp_path / "bids" / "bid_versions")).first().version_number == 4
    assert spark.read.parquet(str(tmp_path / "bids" / "bid_line_items")).count() == 5
    op.write_bid_csv(op.bid_csv(lines, totals), str(tmp_path / "csv"))
    text = [r.value for r in spark.read.text(str(tmp_path / "csv" / "project_id=p")).collect()]
    assert text[0].startswith("Room,Type") and text[-1].startswith("Grand total") and len(text) == 11
    sheets = {"summary": op.bid_summary(totals, owner, new, "2024-01-31"), "lines": op.line_sheet(lines),
              "rooms": op.room_schedule(lines), "symbols": op.symbol_sheet(df)}
    op.write_workbook(sheets, str(tmp_path / "book"))
    assert spark.read.option("header", True).csv(str(tmp_path / "book" / "summary")).count() == 15


def test_workbook_rounds_the_double_itself(spark):
    """1197.495 lies below its half cent as a double, so the sheet shows 1197.49."""
    totals = spark.createDataFrame([("p", 1197.495, 2.5, 0.0, 0.0, 10.0)],
                                   "project_id string, total_material double, total_labor double, total_overhead double, total_markup double, grand_total double")
    versions = spark.createDataFrame([("p", 1)], "project_id string, version_number int")
    who = project(spark).withColumn("client_name", F.lit("C"))
    sheet = {r.field: r.value for r in op.bid_summary(totals, who, versions, "2024-01-31").collect()}
    assert (sheet["Total material"], sheet["Total labor"], sheet["Grand total"]) == ("1197.49", "2.5", "10.0")
