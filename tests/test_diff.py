"""Summary of two takeoffs: rooms told apart by type only where that shows."""

from plumbline.operators import diff

ROWS = "project_id string, surface_id string, room_label string, type string, square_footage double"


def test_summary_needs_no_grouping_by_type(spark):
    old = spark.createDataFrame([("p", "1", "Hall", "wall", 10.0), ("p", "2", "Hall", "trim", None), ("p", "3", "Bath", "wall", 20.0),
                                 ("p", "4", "Attic", "wall", 5.0), ("p", "5", None, "wall", 7.0), ("p", "6", "Hall", "symbol:x", 99.0)], ROWS)
    new = spark.createDataFrame([("p", "1", "Hall", "ceiling", 10.0), ("p", "3", "bath", "wall", 30.0), ("p", "7", "Loft", "wall", 4.0)], ROWS)
    short = diff.diff_summary(old, new)
    whole = diff.diff_summary(old, new, include_unchanged=True)
    kept = [n for n in short.columns if n != "unchanged_rooms"]
    assert short.select(kept).collect() == whole.select(kept).collect()
    row = short.first()
    assert (row.added_rooms, row.removed_rooms, row.resized_rooms, row.unchanged_rooms) == (1, 1, 1, 0)
    assert (row.total_old_sqft, row.total_new_sqft) == (42.0, 44.0)
    kinds = {r.room_label: r.change for r in diff.diff_rooms(old, new, include_unchanged=True).collect()}
    assert kinds["Hall"] == "retyped"
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate" in x for x in plan.splitlines()) == 2
