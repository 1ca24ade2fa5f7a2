"""Faces, components, splitting and text rules on small hand-made plans."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G, plantext as X
from plumbline.operators import geometry as geo, graph, plantext as txt
from plumbline.session import cut

c = F.col


def segs(spark, rows, page="p"):
    return spark.createDataFrame([(page, i, *map(float, r)) for i, r in enumerate(rows)],
                                 "page_id string, seg_id int, x1 double, y1 double, x2 double, y2 double")


def pages(spark):
    return spark.createDataFrame([("p", 1000.0, 1000.0)], "page_id string, page_w double, page_h double")


def square(x, y, s):
    return [(x, y, x + s, y), (x + s, y, x + s, y + s), (x + s, y + s, x, y + s), (x, y + s, x, y)]


def areas(spark, rows, **kw):
    return sorted(round(r.area) for r in graph.room_faces(segs(spark, rows), pages(spark), **kw).collect())


def test_single_square(spark):
    assert areas(spark, square(100, 100, 100)) == [10000]


def test_l_shape_and_t_junction(spark):
    l_shape = [(0, 0, 200, 0), (200, 0, 200, 100), (200, 100, 100, 100), (100, 100, 100, 200), (100, 200, 0, 200), (0, 200, 0, 0)]
    assert areas(spark, l_shape) == [30000]
    assert areas(spark, l_shape + [(100, 0, 100, 100)]) == [10000, 20000]


def test_nested_square_is_its_own_face(spark):
    assert areas(spark, square(0, 0, 300) + square(100, 100, 100)) == [10000, 90000]


def test_crossing_lines_make_four_rooms(spark):
    assert areas(spark, square(0, 0, 200) + [(100, 0, 100, 200), (0, 100, 200, 100)]) == [10000] * 4


def test_door_gap_needs_evidence(spark):
    rows = square(0, 0, 100)[1:] + [(0, 0, 30, 0), (60, 0, 100, 0)]
    assert areas(spark, rows) == [10000]
    door = "page_id string, x double, y double"
    assert areas(spark, rows, doors=spark.createDataFrame([("p", 500.0, 500.0)], door)) == []
    assert areas(spark, rows, doors=spark.createDataFrame([("p", 50.0, 8.0)], door)) == [10000]


def test_many_cornered_faces_are_kept(spark):
    steps = [(i * 20, i * 20, i * 20 + 20, i * 20) for i in range(14)] + [(i * 20 + 20, i * 20, i * 20 + 20, i * 20 + 20) for i in range(14)]
    rows = steps + [(280, 280, 0, 280), (0, 280, 0, 0)]
    assert len(areas(spark, rows)) == 1
    assert areas(spark, rows, max_vertices=24) == []


def test_long_spurs_are_peeled_to_the_end(spark):
    spur = [(i * 5, -i * 5, i * 5 + 5, -i * 5 - 5) for i in range(11)]
    assert graph.prune_stubs(segs(spark, square(0, 0, 100) + spur)).count() == 4


def test_closed_runs_start_at_their_smallest_corner(spark):
    runs = graph.wall_runs(segs(spark, square(10, 20, 50)))
    got = [(r.x, r.y) for r in graph.run_points(runs).orderBy("pos").collect()]
    assert got[0] == got[-1] == (10, 20) and len(got) == 5 and len(set(got)) == 4


def test_components_match_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(0, i) for i in range(100, 140)] + [(i, i + 1) for i in range(200, 240)]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == want


def test_diagonal_lines_merge_and_pair(spark):
    merged = graph.merge_collinear(segs(spark, [(0, 0, 30, 30), (29, 29, 80, 80), (200, 0, 230, 30)])).collect()
    assert len(merged) == 2
    lines = geo.centerlines(segs(spark, [(0, 0, 100, 100), (6, 0, 106, 100)])).collect()
    assert len(lines) == 1 and lines[0].x1 - lines[0].y1 == pytest.approx(3.0)


def test_wall_runs_stop_at_junctions(spark):
    rows = square(0, 0, 50) + [(50, 50, 90, 90), (90, 90, 120, 90)]
    runs = {round(r.length_pt): r.closed for r in graph.run_summary(graph.wall_runs(segs(spark, rows))).collect()}
    assert runs == {200: False, 87: False}
    assert graph.run_summary(graph.wall_runs(segs(spark, square(0, 0, 50)))).first().closed


def test_run_points_walk_in_order(spark):
    rows = square(0, 0, 50) + [(50, 50, 90, 90), (120, 90, 90, 90), (120, 90, 120, 140)]
    got = {}
    for r in graph.run_points(graph.wall_runs(segs(spark, rows))).orderBy("pos").collect():
        got.setdefault(r.run, []).append((r.x, r.y))
    assert sorted(got.values(), key=len) == [[(50, 50), (90, 90), (120, 90), (120, 140)], [(50, 50), (0, 50), (0, 0), (50, 0), (50, 50)]]


def test_net_never_exceeds_gross_and_even_odd(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (5, 5), (0, 10))])
    row = spark.range(1).select(G.net_gross(ring).alias("g"), G.contains_point(ring, F.lit(5.0), F.lit(8.0)).alias("notch"),
                                G.contains_point(ring, F.lit(2.0), F.lit(3.0)).alias("inside"), G.net_gross(F.slice(ring, 1, 2)).alias("few")).first()
    assert row.g.gross == 75.0 and row.g.net <= row.g.gross and not row.notch and row.inside and row.few.gross == 0


@pytest.mark.parametrize("text,feet,confidence", [
    ("12'-6\"", 12.5, 0.99), ("12’-6 1/2”", 12 + 6.5 / 12, 0.99), ("12'11\"", 12 + 11 / 12, 0.99), ("9'", 9.0, 0.95), ("18\"", 1.5, 0.7),
    ("40\"", None, None), ("12'-13\"", None, None), ("1/8\" = 1'-0\"", None, None), ("SCALE 9'", None, None), ("0'", None, None)])
def test_callout_forms(spark, text, feet, confidence):
    got = spark.range(1).select(X.parse_callout(F.lit(text)).alias("c")).first().c
    assert (got is None) if feet is None else (got.length_ft == pytest.approx(feet) and got.confidence == confidence)


@pytest.mark.parametrize("text,size", [("12'6\" x 10'", (12.5, 10.0)), ("12 × 10.5", (12.0, 10.5)), ("12'-6\" x 10'-0\"", None), ("0 x 5", None), ("250 x 5", None)])
def test_dimension_forms(spark, text, size):
    got = spark.range(1).select(X.parse_dim(F.lit(text)).alias("d")).first().d
    assert (None if got is None else tuple(got)) == size


@pytest.mark.parametrize("text,pt", [("SCALE: 1/8\" = 1'-0\"", 9.0), ("3/16\" = 1'", 13.5), ("1 1/2\" = 1'-0\"", None), ("5/7\" = 1'", None)])
def test_imperial_scales(spark, text, pt):
    got = spark.range(1).select(X.imperial_scale(F.lit(text)).alias("s")).first().s
    assert (got and got.pt_per_foot) == (pytest.approx(pt) if pt else None)


@pytest.mark.parametrize("text,room", [
    ("MASTER BEDROOM", True), ("1 Bedroom + Den", False), ("• Billiards room", False), ("Balcony Area", False), ("SEE KITCHEN NOTE", False),
    ("E12", False), ("LIVING ROOM WITH A VERY LONG", False), ("Corridor", True)])
def test_room_labels(spark, text, room):
    assert spark.range(1).select(X.is_table_room(F.lit(text)).alias("r")).first().r is room


def test_door_check_median(spark):
    doors = spark.createDataFrame([("p", float(s)) for s in (5, 26, 27, 28, 29, 30, 31, 32, 33, 400)], "page_id string, size double")
    scale = spark.createDataFrame([("p", 9.0)], "page_id string, pt_per_foot double")
    row = txt.verify_scale(doors, scale).first()
    assert (row.median_pt, row.check, row.doors) == (30.0, "verified", 10)


def test_cut_tables_have_their_measured_size(spark):
    wide = spark.range(10).select(F.explode(F.sequence(F.lit(0), F.lit(20000))).alias("n"), "id")
    assert int(str(cut(wide)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 200_000


def test_components_torn_between_batches(spark):
    rnd = random.Random(3)
    edges = [(p, rnd.randrange(40), rnd.randrange(40)) for p in "abc" for _ in range(40)] + [("d", i, i + 1) for i in range(30)]
    df = spark.createDataFrame(edges, "p string, i int, j int").select(F.struct("p", c("i").alias("n")).alias("a"), F.struct("p", c("j").alias("n")).alias("b"))
    want = {r.node: r.component for r in graph.components(df).collect()}
    for size in (3, 50, 1000):
        got = graph._placed_components(df, "a.p", size).collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_cycles_torn_between_batches(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for length in (1, 2, 3, 7, 40, 90):
        ids = rnd.sample(range(length * 1000, length * 1000 + 999), length)
        low = ids.index(min(ids))
        for k, i in enumerate(ids):
            rows.append(("p", i, ids[(k + 1) % length]))
            want[i] = (min(ids), (low - k) % length)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id string, id long, `to` long")
    for size in (4, 30, 1000):
        assert {r.id: (r.m, r.d) for r in graph._walked(df, "page_id", size).collect()} == want


def test_merged_lines_are_ordered_once_and_repeats_before(spark):
    from plumbline.operators.graph import merge_collinear
    rows = [("p", 0.0, 0.0, 10.0, 0.0)] * 3 + [("p", 10.0, 0.0, 30.0, 0.0), ("p", 50.0, 0.0, 60.0, 0.0)]
    found = merge_collinear(spark.createDataFrame(rows, "page_id string, x1 double, y1 double, x2 double, y2 double"))
    assert sorted(tuple(r) for r in found.collect()) == [("p", 0.0, 0.0, 30.0, 0.0), ("p", 50.0, 0.0, 60.0, 0.0)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 2


def test_rectangles_match_brute_force_and_write_only_what_they_found(spark, monkeypatch):
    import math
    import random

    from plumbline.operators import geometry as rect

    draw = random.Random(7)
    segs = []
    for _ in range(8):
        x, y, w, h = draw.uniform(0, 400), draw.uniform(0, 400), draw.uniform(60, 300), draw.uniform(60, 300)
        segs += [(x, y, x + w, y), (x + w, y, x + w, y + h), (x, y + h, x + w, y + h), (x, y, x, y + h)]
    segs += [(0.0, 100.0, 600.0, 100.0), (0.0, 300.0, 600.0, 300.0), (100.0, 100.0, 100.0, 300.0)]
    tol, found = 1.5, {}
    level = [(math.floor(b / tol + 0.5) * tol, min(a, d), max(a, d)) for a, b, d, e in segs if b == e]
    upright = [(a, min(b, e), max(b, e)) for a, b, d, e in segs if a == d]
    def touches(line, at, lo, hi):
        return line[1] - 2 * tol <= at <= line[2] + 2 * tol and lo - tol <= line[0] <= hi + tol
    for p in level:
        for q in level:
            if q[0] - p[0] < 20:
                continue
            left, right = max(p[1], q[1]), min(p[2], q[2])
            ends = [[at for at, lo, hi in upright if touches(p, at, lo, hi) and touches(q, at, lo, hi) and abs(at - end) <= 1.5 * tol] for end in (left, right)]
            area = (right - left) * (q[0] - p[0])
            if all(ends) and right - left >= 20 and 5000 <= area <= 5e6:
                box = (left, p[0], right, q[0])
                grid = tuple(math.floor(v + 0.5) for v in box)
                found[grid] = max(found.get(grid, (0.0,)), (area, box))
    want = sorted(b for a, b in found.values() if not any(
        oa > a and all(b[i] >= o[i] - tol for i in (0, 1)) and all(b[i] <= o[i] + tol for i in (2, 3)) for oa, o in found.values()))
    written = []
    monkeypatch.setattr(rect, "cut", lambda df, real=rect.cut: written.append(real(df)) or written[-1])
    rows = spark.createDataFrame([("1", 0, *map(float, s)) for s in segs], "page_id string, seg_id long, x1 double, y1 double, x2 double, y2 double")
    got = sorted(tuple(r.box) for r in rect.rectangles(rows).collect())
    assert len(want) >= 3 and [[round(v, 6) for v in b] for b in got] == [[round(v, 6) for v in b] for b in want]
    assert [t.count() for t in written] == [len(found)]


def test_spread_rows_are_shuffled_not_broadcast(spark):
    """Copies per cell are not in the planner's estimate, which goes by the size of the input's files."""
    near = graph.spread(spark.range(1).select(F.lit("p").alias("page_id"), F.lit(5.0).alias("x")), F.col("x") - 9, F.lit(0.0), F.col("x") + 9, F.lit(0.0), 4.0)
    here = spark.range(1).select(F.lit("p").alias("page_id"), F.lit(1).cast("long").alias("_cx"), F.lit(0).cast("long").alias("_cy"))
    met = here.join(near.select("page_id", "_cx", "_cy", "x"), ["page_id", "_cx", "_cy"])
    assert "strategy=merge" in met._jdf.queryExecution().optimizedPlan().toString()
    assert met.count() == 1


def test_run_points_carry_ids_through_their_rounds(spark, monkeypatch):
    """A long open run and a closed one: rounds hold numbers only, and their superseded tables go."""
    kept, gone = [], []
    real_cut, real_release = graph.cut, graph.release
    monkeypatch.setattr(graph, "cut", lambda df: kept.append(df.dtypes) or real_cut(df))
    monkeypatch.setattr(graph, "release", lambda spark, *old: gone.append(len(old)) or real_release(spark, *old))
    open_run = [(i * 10, 0, i * 10 + 10, 0) for i in range(9)]
    runs = cut(graph.wall_runs(segs(spark, open_run + square(0, 100, 50)).drop("seg_id")))
    kept.clear(), gone.clear()
    rows = [(r.pos, r.x, r.y) for r in graph.run_points(runs).orderBy("y", "pos").collect()]
    assert rows[:10] == [(i, i * 10.0, 0.0) for i in range(10)]
    assert sorted(p for p, _, _ in rows[10:]) == [0, 1, 2, 3, 4] and [(x, y) for p, x, y in rows if y >= 100 and p in (0, 4)] == [(0.0, 100.0)] * 2
    assert gone and all(set(dict(d).values()) <= {"bigint", "int"} for d in kept[1:])


def test_whole_faces_leave_their_batch_as_one_row(spark, monkeypatch):
    """Whatever the batches tear apart, the faces are the same; what is written holds no half-edge of a whole face."""
    rows = square(0, 0, 40) + square(40, 0, 40) + square(200, 200, 30) + [(300 + i, 0, 301 + i, 0) for i in range(6)]
    half = cut(graph.half_edges(graph.distinct_segments(segs(spark, rows))))
    written = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(real(df)) or written[-1])
    found = {}
    for size in (1 << 18, 5):
        written.clear()
        found[size] = sorted((r.face, r.vertices, r.area, tuple(r.box), tuple(map(tuple, r.polygon))) for r in graph.faces(half, batch_rows=size).collect())
        if size > 5:
            assert written[0].count() == len(found[size]) and written[0].where("face IS NULL").isEmpty()
    assert found[5] == found[1 << 18]
    assert sorted(a for _, _, a, _, _ in found[5] if a > 0) == [900.0, 1600.0, 1600.0]


def test_pages_lie_side_by_side_in_batches(spark, monkeypatch):
    """Mixed up pages, batches of two of them: no face waits for the rounds, and no component is torn."""
    rows = [(f"p{p}", *map(float, r)) for p in range(30) for r in square(0, 0, 40)]
    random.Random(3).shuffle(rows)
    drawn = spark.createDataFrame(rows, "page_id string, x1 double, y1 double, x2 double, y2 double").coalesce(1)
    half = cut(graph.half_edges(graph.distinct_segments(drawn)))
    written = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(real(df)) or written[-1])
    assert graph.faces(half, batch_rows=16).where("area > 0").count() == 30
    assert written[0].where("face IS NULL").isEmpty()
    written.clear()
    edges = drawn.select(graph._p(1).alias("a"), graph._p(2).alias("b"))
    assert graph._placed_components(edges, "a.page_id", batch_rows=8).select("component").distinct().count() == 30
    assert written[1].count() <= 10  # links between batches: not one per node
