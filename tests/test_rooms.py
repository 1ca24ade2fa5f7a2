"""Room extraction on hand-made pages."""

from plumbline.operators import rooms

FRAGMENT = "page_id string, seq int, text string, x double, y double, width double, height double, rotation double, page_w double, page_h double"
FACE = ("page_id string, face string, area double, box struct<x0:double,y0:double,x1:double,y1:double>, "
        "polygon array<struct<x:double,y:double>>")


def face(name, x0, y0, x1, y1):
    return ("p", name, (x1 - x0) * (y1 - y0), (x0, y0, x1, y1), [(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def label(seq, text, x, y):
    return ("p", seq, text, x - 20.0, y - 5.0, 40.0, 10.0, 0.0, 1224.0, 792.0)


def extract(spark, labels, faces, walls=8, **limits):
    far = [("p", i, 1100.0, 700.0 + i, 1102.0, 700.0 + i) for i in range(walls)]
    scales = spark.createDataFrame([("p", 10.0)], "page_id string, pt_per_foot double")
    found, status = rooms.extract_rooms(
        spark.createDataFrame(labels, FRAGMENT), spark.createDataFrame(far, "page_id string, seg_id int, x1 double, y1 double, x2 double, y2 double"),
        spark.createDataFrame(faces, FACE), scales, spark.createDataFrame([("p", 500)], "page_id string, ops int"),
        spark.createDataFrame([("p", 500000.0)], "page_id string, plan_area double"), **limits)
    return {r.label: (r.area_sqft, r.derivation) for r in found.collect()}, [(r.status, r.reason) for r in status.collect()]


def test_a_face_around_an_accepted_room_is_refused(spark):
    nested = [face("inner", 100.0, 100.0, 300.0, 300.0), face("outer", 50.0, 50.0, 500.0, 500.0)]
    got, status = extract(spark, [label(0, "KITCHEN", 200.0, 200.0), label(1, "OFFICE", 420.0, 420.0)], nested)
    assert got == {"KITCHEN": (400.0, "scale-measured"), "OFFICE": (None, "geometry-uncertain")}
    assert status == [("ok", None)]


def test_neighbouring_faces_both_count(spark):
    side = [face("a", 100.0, 100.0, 300.0, 300.0), face("b", 300.0, 100.0, 500.0, 300.0)]
    got, _ = extract(spark, [label(0, "KITCHEN", 200.0, 200.0), label(1, "OFFICE", 400.0, 200.0)], side)
    assert got == {"KITCHEN": (400.0, "scale-measured"), "OFFICE": (400.0, "scale-measured")}


def test_pages_below_a_limit_get_a_reason(spark):
    one = [face("a", 100.0, 100.0, 300.0, 300.0)]
    labels = [label(i, "KITCHEN", 200.0, 200.0 + i) for i in range(3)]
    assert extract(spark, labels, one, walls=3) == ({}, [("skipped", "few_walls")])
    assert extract(spark, labels, one, walls=3, min_walls=2)[1] == [("ok", None)]


def test_warnings(spark):
    side = [face("a", 100.0, 100.0, 300.0, 300.0), face("b", 300.0, 100.0, 320.0, 300.0)]
    rows = [label(0, "KITCHEN", 200.0, 200.0), label(1, "OFFICE", 310.0, 200.0), label(2, "BEDROOM", 700.0, 600.0)]
    far = [("p", i, 1100.0, 700.0 + i, 1102.0, 700.0 + i) for i in range(8)]
    found, status = rooms.extract_rooms(
        spark.createDataFrame(rows, FRAGMENT), spark.createDataFrame(far, "page_id string, seg_id int, x1 double, y1 double, x2 double, y2 double"),
        spark.createDataFrame(side, FACE), spark.createDataFrame([("p", 10.0)], "page_id string, pt_per_foot double"),
        spark.createDataFrame([("p", 500)], "page_id string, ops int"), spark.createDataFrame([("p", 500000.0)], "page_id string, plan_area double"))
    got = {r.label: (r.derivation, r.warning) for r in found.collect()}
    assert got["KITCHEN"] == ("scale-measured", None)
    assert got["OFFICE"][0] == got["BEDROOM"][0] == "geometry-uncertain"
    assert "too narrow" in got["OFFICE"][1] and "by hand" in got["BEDROOM"][1]
    assert [(r.fragments, r.table_rows, r.walls, r.faces) for r in status.collect()] == [(3, 0, 8, 2)]


def test_inputs_of_the_whole_job_are_worked_out_once(spark):
    def counted(df, seen):
        def run(parts):
            for part in parts:
                seen.add(len(part))
                yield part
        return df.mapInPandas(run, df.schema)

    texts, walls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    sides = [(100.0, 100.0, 300.0, 100.0), (300.0, 100.0, 300.0, 300.0), (100.0, 300.0, 300.0, 300.0), (100.0, 100.0, 100.0, 300.0)]
    segs = spark.createDataFrame([("p", i, *s) for i, s in enumerate(sides)], "page_id string, seg_id int, x1 double, y1 double, x2 double, y2 double")
    found, status = rooms.extract_from_segments(
        counted(spark.createDataFrame([label(0, "KITCHEN", 200.0, 200.0)], FRAGMENT), texts), counted(segs, walls),
        spark.createDataFrame([("p", 10.0)], "page_id string, pt_per_foot double"), spark.createDataFrame([("p", 500)], "page_id string, ops int"),
        spark.createDataFrame([("p", 500000.0)], "page_id string, plan_area double"), min_walls=4)
    assert [(r.label, r.area_sqft) for r in found.collect()] == [("KITCHEN", 400.0)]
    assert [(r.status, r.fragments, r.walls) for r in status.collect()] == [("ok", 1, 4)]
    assert (texts.value, walls.value) == (1, 4)


def test_rows_of_a_table_are_not_broadcast_by_the_size_of_their_files(spark):
    """Files of the rows pack far below their size in memory: neither their keys nor their places choose a broadcast by them."""
    found = rooms.table_rooms(
        spark.createDataFrame([label(0, "KITCHEN", 200.0, 200.0)], FRAGMENT), spark.createDataFrame([face("inner", 100.0, 100.0, 300.0, 300.0)], FACE),
        spark.createDataFrame([("p", 10.0)], "page_id string, pt_per_foot double"),
        spark.createDataFrame([("p", 500000.0)], "page_id string, plan_area double"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 3  # labels with places, rows with places, places with faces' cells
