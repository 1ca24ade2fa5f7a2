"""Greedy matching and label rules against direct evaluation; files and fusion."""

import json
import random
import re

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import accuracy as op, fusion, geometry as geo, quality
from plumbline.sources import files

STOP = set(T.SCORED_STOP_WORDS)


def tokens(label):
    plain = re.sub(r"[^a-z0-9]+", " ", re.sub(r"\([^)]*\)|\[[^\]]*\]", "", label.lower()))
    return [t for t in plain.split() if len(t) >= 3 and t not in STOP]


def touches(a, b):
    return any(x == y or (len(x) >= 4 and x in y) or (len(y) >= 4 and y in x) for x in a for y in b)


def greedy(truth, cand):
    pairs = []
    for i, lt in truth:
        for j, lc, area in cand:
            a, b = tokens(lt), tokens(lc)
            if area is not None and a and b and touches(a, b):
                pairs.append((-len(set(a) & set(b)) / len(set(a) | set(b)), i, j))
    used_i, used_j, out = set(), set(), set()
    for _, i, j in sorted(pairs):
        if i not in used_i and j not in used_j:
            used_i.add(i), used_j.add(j), out.add((i, j))
    return out


def test_greedy_matches_sorted_pairs(spark):
    rnd = random.Random(4)
    words = ["bath", "bathroom", "bed", "bedroom", "closet", "kitchen", "hall", "office", "storage", "2nd"]
    label = lambda: rnd.choice(["", "Master ", "(x) "]) + " ".join(rnd.sample(words, rnd.choice([1, 1, 2])))
    truth = [(i, label()) for i in range(40)]
    cand = [(j, label(), rnd.choice([None, 10.0, 20.0, 30.0])) for j in range(45)]
    t = spark.createDataFrame([("p", i, s, 1.0) for i, s in truth], "plan_id string, ord bigint, label string, area double")
    d = spark.createDataFrame([("p", j, s, a) for j, s, a in cand], "plan_id string, ord bigint, label string, area double")
    got = {(r.truth_ord, r.cand_ord) for r in op.match_greedy(t, d, width=8).collect()}
    assert got == greedy(truth, cand)


def test_first_come_chain(spark):
    nodes = spark.createDataFrame([("g", i) for i in range(6)], "grp string, ord int")
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(5)], "grp string, earlier int, later int")
    assert {r.ord for r in geo.first_come(nodes, edges).collect()} == {0, 2, 4}


def test_serial_pick_is_in_order(spark):
    rows = [("g", 1, "a", 1.0), ("g", 1, "b", 2.0), ("g", 2, "a", 1.0), ("g", 2, "b", 2.0), ("g", 3, "a", 1.0), ("g", 3, "c", 9.0)]
    got = geo.serial_pick(spark.createDataFrame(rows, "grp string, ord int, item string, rank double")).collect()
    assert {(r.ord, r.item) for r in got} == {(1, "a"), (2, "b"), (3, "c")}


def test_ground_truth_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"rooms": [{"label": "Den", "floorAreaSqft": 90}]}))
    (tmp_path / "b.json").write_text(json.dumps({"pages": [{"pageNumber": 2, "rooms": [
        {"label": "Hall", "trueFloorAreaSqft": 50, "matchKeys": ["hall"]}, {"label": "Deck", "widthFt": 4, "heightFt": 5, "interior": False}]}]}))
    rows = {r.label: r for r in files.load_ground_truth(spark, str(tmp_path)).collect()}
    assert (rows["Den"].floor_area, rows["Hall"].floor_area, rows["Deck"].floor_area) == (90, 50, 20)
    assert rows["Hall"].page_number == 2 and rows["Hall"].match_keys == ["hall"] and not rows["Deck"].interior
    assert files.hash_files(spark, str(tmp_path / "a.json")).first().length > 0


def test_finish_schedule_from_summary(spark):
    text = json.dumps({"finishSchedule": [{"room": "Lobby", "paintType": "satin"}, {"room": "Hall", "paintType": "flat"}]})
    specs = spark.createDataFrame([("p", text), ("q", "broken{")], "project_id string, ai_summary string")
    assert [(r.project_id, r.pos, r.room, r.paint_type) for r in files.finish_schedule(specs).collect()] == [
        ("p", 0, "Lobby", "satin"), ("p", 1, "Hall", "flat")]


TAKEOFF = "takeoff_id string, ord string, type string, room_label string, area_sqft double, linear_ft double, count int, substrate string, confidence double"


def test_plausibility_rules(spark):
    rows = [("t", "1", "wall", "Bath ", 300.0, 20.0, None, None, 0.9), ("t", "2", "ceiling", "bath", 100.0, None, None, None, 0.9),
            ("t", "3", "wall", "Hall", 360.0, 40.0, None, None, 0.9), ("t", "4", "wall", "Null", None, 40.0, None, None, 0.9)]
    flags, fixed = quality.plausibility(spark.createDataFrame(rows, TAKEOFF))
    assert {(r.ord, r.kind) for r in flags.collect()} == {("1", "wall_area_vs_perimeter"), ("1", "tiny_room_huge_walls"), ("2", "ceiling_oversize")}
    got = {r.ord: (r.area_sqft, r.confidence) for r in fixed.collect()}
    assert abs(got["1"][0] - 20 * 9 * 0.93) < 1e-9 and got["1"][1] == 0.55
    assert got["2"] == (22.5, 0.5) and got["3"] == (360.0, 0.9)


def test_fusion_order(spark):
    takeoff = spark.createDataFrame([("t", "1", "wall", "Bedroom #2", 999.0, 50.0, None, "wood", 0.7), ("t", "2", "door", "Nowhere", None, None, 1, None, 0.7)], TAKEOFF)
    rooms = spark.createDataFrame([("t", 1, "BEDROOM", 120.0, 44.0, "traced")],
                                  "takeoff_id string, ord int, label string, area_sqft double, perimeter_ft double, derivation string")
    table = spark.createDataFrame([], "takeoff_id string, ord int, label string, width_ft double, height_ft double")
    notes = spark.createDataFrame([("t", 0, "wall", "bed", "high", 10.0, None)],
                                  "takeoff_id string, pos int, kind string, room_label string, severity string, suggested_area double, suggested_count int")
    got = {r.ord: r for r in fusion.fuse(takeoff, table, notes, rooms, F.lit(8.0)).collect()}
    assert (got["1"].area_sqft, got["1"].linear_ft, got["1"].derivation, got["1"].confidence) == (352.0, 44.0, "traced", 0.5)
    assert got["2"].derivation == "ai-fallback"


def test_room_lookup_spreads_only_beginnings_of_known_lengths(spark):
    from plumbline.operators.fusion import room_lookup
    labels = spark.createDataFrame([("t", "Cold Room 12"), ("t", "B"), ("t", "Hot"), ("t", "x")], "takeoff_id string, room_label string")
    rooms = spark.createDataFrame([("t", 2, "COLD", 1.0), ("t", 1, "cold room", 2.0), ("t", 3, "BATH", 3.0), ("t", 4, "Hot", 4.0)],
                                  "takeoff_id string, ord int, label string, area double")
    found = room_lookup(labels, rooms)
    assert sorted((r.k, r.room.area) for r in found.collect()) == [("b", 3.0), ("coldroom12", 2.0), ("hot", 4.0)]
    assert "sequence(" not in found._jdf.queryExecution().sparkPlan().toString()


def test_labels_are_spread_only_over_beginnings_of_their_plan(spark):
    from plumbline.operators.accuracy import match_largest, spots

    inner = spark.createDataFrame([("p", "con"), ("p", "hal"), ("q", "off")], "plan_id string, _k string")
    outer = spark.createDataFrame([("p", "conference room"), ("p", "main hall con"), ("q", "conference room")], "plan_id string, dl string")
    few = sorted(tuple(r) for r in spots(inner, outer, "dl").select("plan_id", "dl", "_k").collect())
    assert few == [("p", "conference room", "con"), ("p", "main hall con", "con"), ("p", "main hall con", "hal")]
    many = {tuple(r) for r in spots(inner, outer, "dl", most=1).select("plan_id", "dl", "_k").collect()}
    assert set(few) <= many and ("q", "conference room", "off") not in many
    truth = spark.createDataFrame([("p", 1, "Hall", 5.0), ("p", 2, "x", 6.0)], "plan_id string, ord long, label string, area double")
    cand = spark.createDataFrame([("p", 1, "main hall", 7.0), ("p", 2, "X-ray", None), ("r", 3, "hall", 9.0)], truth.schema)
    found = {r["ord"]: (r["hits"], r["largest"]) for r in match_largest(truth, cand).collect()}
    assert found == {1: (1, 7.0), 2: (1, None)}
