"""Room extraction for all pages: printed tables, vector geometry, candidates and the page driver.

Inputs: ``fragments`` (page_id, seq, text, x, y, width, height, rotation, page_w, page_h), ``segs``
(page_id, seg_id, x1, y1, x2, y2), ``scales`` (page_id, pt_per_foot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import geometry as G, plantext as X, text as T
from plumbline.operators import geometry as geo, plantext as txt
from plumbline.operators.graph import cell, room_faces, spread
from plumbline.operators.zones import number_text, open_zones
from plumbline.session import cut

c = F.col
#: Fewest wall segments of a page worth measuring, and fewest rows that make a printed table.  Pages below either
#: limit get no rooms of that kind; ``extract_rooms`` gives each such page a status row with the reason.
MIN_WALLS = 8
MIN_TABLE_ROWS = 2
ROOM = ["page_id", "label", "box", "polygon", "width_ft", "height_ft", "area_sqft", "perimeter_ft", "derivation", "warning"]
#: Least face area in square points: for labels of a printed table, and for labels measured by geometry alone.
TABLE_FACE, VECTOR_FACE = 800.0, 1500.0


def _tenth(v: Column) -> Column:
    return F.floor(v * 10 + 0.5) / 10


def _page_sizes(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("page_id").agg(F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"))


def _box_polygon() -> Column:
    """The box as a clamped polygon in normalised page coordinates."""
    return G.to_page(G.rectangle(c("box.x0"), c("box.y1"), c("box.x1"), c("box.y0")), c("page_w"), c("page_h"))


# --- printed table (J9) ---------------------------------------------------------------------------
def table_rooms(fragments: DataFrame, faces: DataFrame, scales: DataFrame, plan_areas: DataFrame,
                min_rows: int = MIN_TABLE_ROWS, rows: DataFrame | None = None) -> DataFrame:
    """Rooms of pages whose table has at least ``min_rows`` rows; ``rows`` are the ``dim_rows`` if they are known.

    A row's label elsewhere on the plan places it: inside a wall face it is traced, and cross-checked
    when the scaled face agrees within 10 %; otherwise a rectangle of its size is drawn; without such
    a label only the numbers remain.  Printed numbers always win.
    """
    rows = txt.dim_rows(fragments) if rows is None else rows
    enough = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where(c("n") >= min_rows)
    rows = cut(rows.join(enough.select("page_id"), "page_id", "left_semi"))
    key = T.alnum_key
    boxes = txt.dim_table_box(fragments).select("page_id", F.struct("x0", "y0", "x1", "y1").alias("table_box"))
    mid = lambda a, b: c(a) + c(b) / 2
    spots = (fragments.where(~X.in_margin(*[c(n) for n in ("x", "y", "width", "height", "page_w", "page_h")]))
             .withColumn("px", mid("x", "width")).withColumn("py", mid("y", "height")).join(boxes, "page_id", "left")
             .where(c("table_box").isNull() | ~G.in_box(c("px"), c("py"), c("table_box")))
             .select("page_id", key(c("text")).alias("k"), c("seq").alias("spot_seq"), "px", "py"))
    # the planner takes a few columns of the rows' files for far less than they are unpacked, and would broadcast them
    placed = (rows.withColumn("k", key(c("label"))).where(c("k") != "").join(spots.hint("merge"), ["page_id", "k"])
              .where(c("spot_seq") != c("label_seq"))
              .groupBy("page_id", "seq").agg(F.min_by(F.struct("px", "py"), "spot_seq").alias("spot")))
    rows = rows.join(placed.hint("merge"), ["page_id", "seq"], "left").join(scales.select("page_id", "pt_per_foot"), "page_id", "left")
    points = rows.where(c("spot").isNotNull()).select("page_id", c("seq").alias("point_id"), c("spot.px").alias("x"), c("spot.py").alias("y"))
    inside = geo.enclosing_face(points, faces).select("page_id", c("point_id").alias("seq"), "face")
    shape = faces.select("page_id", "face", "box", "polygon", c("area").alias("face_area"))
    hint = txt.sizing_hint(rows, plan_areas).withColumnRenamed("pt_per_foot", "hint")
    all_ = (rows.join(inside, ["page_id", "seq"], "left").join(shape, ["page_id", "face"], "left")
            .join(hint, "page_id", "left").join(_page_sizes(fragments), "page_id"))
    scale = F.when(c("pt_per_foot") > 0, c("pt_per_foot"))
    draw = F.coalesce(scale, c("hint"))
    ratio = c("face_area") / (scale * scale) / (c("width_ft") * c("height_ft"))
    sized = c("spot").isNotNull() & draw.isNotNull()
    derivation = (F.when(c("face").isNotNull() & ratio.between(0.9, 1.1), "table-cross-checked").when(c("face").isNotNull(), "traced")
                  .when(sized, "sized-from-dimensions").otherwise("table-only"))
    half_w, half_h = c("width_ft") * draw / 2, c("height_ft") * draw / 2
    drawn = F.struct((c("spot.px") - half_w).alias("x0"), (c("spot.py") - half_h).alias("y0"),
                     (c("spot.px") + half_w).alias("x1"), (c("spot.py") + half_h).alias("y1"))
    run = F.when(c("face").isNotNull() & scale.isNotNull(), G.perimeter(c("polygon")) / scale).otherwise((c("width_ft") + c("height_ft")) * 2)
    out = all_.withColumn("derivation", derivation).withColumn("perimeter_ft", _tenth(run)).withColumn(
        "_traced", c("face").isNotNull()).withColumn("box", F.when(c("_traced"), c("box")).when(sized, drawn))
    polygon = (F.when(c("_traced"), G.to_page(c("polygon"), c("page_w"), c("page_h"))).when(sized, _box_polygon())
               .otherwise(F.array().cast(G.POINTS)))
    printed, traced = c("width_ft") * c("height_ft"), c("face_area") / (scale * scale)
    off = F.round((ratio - 1) * 100).cast("int")
    warning = F.when(c("_traced") & ~ratio.between(0.9, 1.1), F.concat(
        F.lit("The table gives "), number_text(_tenth(printed)), F.lit(" sqft, the traced face "), number_text(_tenth(traced)),
        F.lit(" sqft ("), F.when(off >= 0, F.lit("+")).otherwise(F.lit("")), off.cast("string"), F.lit("%); the table counts.")))
    return out.withColumn("polygon", polygon).withColumn("warning", warning).select(*ROOM)


# --- callouts against a drawn box (part of J10) -------------------------------------------------------
def callout_dimensions(labels: DataFrame, callouts: DataFrame, radius: float = 100.0, tol: float = 0.3) -> DataFrame:
    """Printed width and height near a label that agree with its box within 30 % on both axes.

    ``labels``: page_id, label_id, cx, cy, bw, bh (box sides in feet).  Text without a direction
    counts as a width above or below the label and as a height beside it, when one axis has none.
    """
    near = callouts.where(c("length_ft").between(3, 60)).select("page_id", "seq", "x", "y", "length_ft", "orientation")
    around = spread(near, c("x") - radius, c("y") - radius, c("x") + radius, c("y") + radius, radius)
    here = labels.select("page_id", "label_id", "cx", "cy", "bw", "bh").withColumn("_cx", cell(c("cx"), radius)).withColumn(
        "_cy", cell(c("cy"), radius))
    pairs = here.join(around, ["page_id", "_cx", "_cy"]).where(F.hypot(c("x") - c("cx"), c("y") - c("cy")) <= radius)
    guess = F.when(F.abs(c("y") - c("cy")) > F.abs(c("x") - c("cx")), "h").otherwise("v")
    marked = pairs.withColumn("guess", F.when(c("orientation").isNull(), guess))

    def closest(axis: str, side: str, own: str) -> Column:
        err = F.abs(c("length_ft") - c(side)) / F.greatest(F.lit(1.0), c(side))
        return F.min_by(F.when((c(own) == axis) & (err <= tol), c("length_ft")),
                        F.when((c(own) == axis) & (err <= tol), F.struct(err, -c("seq"))))

    facts = marked.groupBy("page_id", "label_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("orientation") == "h").alias("nh"), F.count_if(c("orientation") == "v").alias("nv"),
        *[closest(axis, side, own).alias(f"{axis}_{own}") for axis, side in (("h", "bw"), ("v", "bh")) for own in ("orientation", "guess")],
        *[F.min(F.when((c(own) == axis), F.abs(c("length_ft") - c(side)))).alias(f"e_{axis}_{own}")
          for axis, side in (("h", "bw"), ("v", "bh")) for own in ("orientation", "guess")])
    loose = (c("nh") == 0) | (c("nv") == 0)

    def pick(axis: str) -> Column:
        printed, guessed = c(f"{axis}_orientation"), F.when(loose, c(f"{axis}_guess"))
        nearer = c(f"e_{axis}_guess") < c(f"e_{axis}_orientation")
        return F.when(guessed.isNotNull() & (printed.isNull() | nearer), guessed).otherwise(printed)

    return (facts.where(c("n") >= 2).select("page_id", "label_id", pick("h").alias("pw"), pick("v").alias("ph"))
            .where(c("pw").isNotNull() & c("ph").isNotNull()))


# --- vector geometry (J10) --------------------------------------------------------------------------------
def vector_rooms(fragments: DataFrame, segs: DataFrame, faces: DataFrame, scales: DataFrame, callouts: DataFrame,
                 min_walls: int = MIN_WALLS) -> DataFrame:
    """Rooms from label clusters on pages with at least ``min_walls`` walls.

    A label's rectangle comes from the nearest long walls, with a second, closer look where the first
    gives none; rectangles over 15 % of the page or more than half inside an earlier one are refused.
    What is left chooses a wall face; faces are then accepted in label order unless their box overlaps a
    rectangle or an accepted face, so a label between nested walls gets no number over the room it holds.
    Labels without either stay as uncertain.  All rectangles are settled before faces are given out, whereas a strictly sequential
    pass would let an earlier label's face refuse a later label's rectangle.
    """
    busy = segs.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where(c("n") >= min_walls).select("page_id")
    words = txt.read_text(fragments).where("_room").join(busy, "page_id", "left_semi")
    labels = cut(geo.label_clusters(words.select("page_id", "seq", "text", "x", "y", "width", "height"))
                 .join(_page_sizes(fragments), "page_id"))
    side = F.least("page_w", "page_h")
    w, h = c("box.x1") - c("box.x0"), c("box.y1") - c("box.y0")

    def rays(of: DataFrame, clearance: float) -> DataFrame:
        """Rectangles with ``fits`` for those that are not too large for their page."""
        found = geo.ray_rooms(of, segs, 20.0, 1e9, 25.0, clearance, keep=["page_w", "page_h"])
        return found.where((w <= side * 0.4) & (h <= side * 0.4)).select(
            "page_id", "label_id", "box", (w * h <= c("page_w") * c("page_h") * 0.15).alias("fits"))

    strict = cut(rays(labels, 12.0))
    missed = cut(labels.join(strict, ["page_id", "label_id"], "left_anti"))
    boxed = strict if missed.isEmpty() else strict.unionByName(rays(missed, 2.0))
    boxed = boxed.where("fits").select("page_id", c("label_id").alias("ord"), "box")
    kept = cut(geo.drop_overlaps(boxed)).withColumnRenamed("ord", "label_id")
    rest = labels.join(kept, ["page_id", "label_id"], "left_anti")
    taken = geo.label_faces(rest.withColumn("ord", c("label_id")), faces, side * 0.04).withColumnRenamed("ord", "label_id")
    placed = cut(taken.join(faces.select("page_id", "face", "box", "polygon"), ["page_id", "face"])
                 .select("page_id", "label_id", "box", "polygon"))
    here = spread(placed.select("page_id", "label_id", "box"), c("box.x0"), c("box.y0"), c("box.x1"), c("box.y1"), 100.0)
    apart = lambda k: ((c("box.x1") <= c(f"{k}.x0")) | (c(f"{k}.x1") <= c("box.x0"))
                       | (c("box.y1") <= c(f"{k}.y0")) | (c(f"{k}.y1") <= c("box.y0")))
    boxes = spread(kept.select("page_id", c("box").alias("kb")), c("kb.x0"), c("kb.y0"), c("kb.x1"), c("kb.y1"), 100.0)
    blocked = here.join(boxes, ["page_id", "_cx", "_cy"]).where(~apart("kb")).select("page_id", "label_id")
    alone = cut(placed.join(blocked, ["page_id", "label_id"], "left_anti"))
    one = here.join(alone.select("page_id", "label_id"), ["page_id", "label_id"], "left_semi")
    two = one.select("page_id", "_cx", "_cy", c("label_id").alias("later"), c("box").alias("lb"))
    rivals = one.join(two, ["page_id", "_cx", "_cy"]).where((c("label_id") < c("later")) & ~apart("lb"))
    first = geo.first_come(alone.select(c("page_id").alias("grp"), c("label_id").alias("ord")),
                           rivals.select(c("page_id").alias("grp"), c("label_id").alias("earlier"), "later"))
    traced = alone.join(first.select(c("grp").alias("page_id"), c("ord").alias("label_id")), ["page_id", "label_id"])
    ring = G.rectangle(c("box.x0"), c("box.y0"), c("box.x1"), c("box.y1"))
    shapes = kept.withColumn("polygon", ring).unionByName(traced)
    all_ = cut(labels.join(shapes, ["page_id", "label_id"], "left").join(scales.select("page_id", "pt_per_foot"), "page_id", "left")
               .withColumn("pt", F.when(c("pt_per_foot") > 0, c("pt_per_foot"))))
    bw, bh = (c("box.x1") - c("box.x0")) / c("pt"), (c("box.y1") - c("box.y0")) / c("pt")
    printed = callout_dimensions(all_.where(c("box").isNotNull() & c("pt").isNotNull()).withColumn("bw", bw).withColumn("bh", bh), callouts)
    measured = (all_.join(printed, ["page_id", "label_id"], "left").withColumn("mw", _tenth(bw)).withColumn("mh", _tenth(bh))
                .withColumn("ma", _tenth(G.area(c("polygon")) / (c("pt") * c("pt")))).withColumn("mp", _tenth(G.perimeter(c("polygon")) / c("pt"))))
    has_print = c("pw").isNotNull()
    skinny = F.greatest("mw", "mh") / F.least("mw", "mh") > 8
    smallest = X.min_room_sqft(c("text"))
    state = (F.when(c("box").isNull(), "geometry-uncertain").when(c("pt").isNull(), "scale-needed").when(has_print, "scale-measured")
             .when(F.coalesce(skinny, F.lit(False)) | ((smallest > 0) & (c("ma") < smallest)), "geometry-uncertain").otherwise("scale-measured"))
    out = measured.withColumn("derivation", state).where(c("box").isNotNull() | X.is_certain_room(c("text")))
    sure = c("derivation") == "scale-measured"
    value = lambda print_, own: F.when(sure, F.when(has_print, print_).otherwise(own))
    found = F.concat(F.lit('Found "'), c("text"), F.lit('", '))
    warning = (F.when(c("box").isNull(), F.concat(found, F.lit("but no reliable boundary or printed dimension; measure it by hand.")))
               .when(has_print & (F.abs(c("pw") * c("ph") - c("ma")) / c("ma") > 0.25), F.concat(
                   F.lit("The boundary gives "), F.round("ma").cast("int").cast("string"), F.lit(" sqft, the printed dimensions "),
                   F.round(c("pw") * c("ph")).cast("int").cast("string"), F.lit(" sqft; the printed ones count.")))
               .when(sure | c("pt").isNull(), None)
               .when(F.coalesce(skinny, F.lit(False)), F.concat(found, F.lit("but its bounds are too narrow for a room.")))
               .otherwise(F.concat(found, F.lit("but its boundary has only "), F.round("ma").cast("int").cast("string"),
                                   F.lit(" sqft, less than such a room has."))))
    measured_rows = cut(out.select(
        "page_id", "label_id", "cx", "cy", "page_w", "page_h", c("text").alias("label"), "box",
        F.when(c("polygon").isNotNull(), G.to_page(c("polygon"), c("page_w"), c("page_h"))).otherwise(F.array().cast(G.POINTS)).alias("polygon"),
        value(c("pw"), c("mw")).alias("width_ft"), value(c("ph"), c("mh")).alias("height_ft"),
        value(_tenth(c("pw") * c("ph")), c("ma")).alias("area_sqft"), value(_tenth((c("pw") + c("ph")) * 2), c("mp")).alias("perimeter_ft"),
        "derivation", warning.alias("warning")))
    return _with_zones(measured_rows, segs, scales, callouts).select(*ROOM)


def _with_zones(rows: DataFrame, segs: DataFrame, scales: DataFrame, callouts: DataFrame) -> DataFrame:
    """Rooms that nothing encloses get their share of an open zone, and so do measured rooms that contradict it.

    Each room is placed by its own label, also where several rooms have the same text.
    """
    uncertain = c("derivation") == "geometry-uncertain"
    labels = rows.where(X.is_certain_room(c("label")) & (uncertain | c("box").isNotNull())).select(
        "page_id", "label_id", c("label").alias("text"), "cx", "cy", uncertain.alias("failed"), "box", "area_sqft")
    todo = cut(labels.where("failed").select("page_id").distinct())
    if todo.isEmpty():
        return rows
    todo = todo.hint("merge")
    here = segs.join(todo, "page_id", "left_semi")
    envelope = here.groupBy("page_id").agg(F.struct(
        F.min(F.least("x1", "x2")).alias("x0"), F.min(F.least("y1", "y2")).alias("y0"),
        F.max(F.greatest("x1", "x2")).alias("x1"), F.max(F.greatest("y1", "y2")).alias("y1")).alias("envelope"))
    sizes = rows.groupBy("page_id").agg(F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"))
    pages = todo.join(sizes, "page_id").join(scales.select("page_id", "pt_per_foot"), "page_id", "left").join(envelope, "page_id", "left")
    found, _ = open_zones(labels.join(todo, "page_id", "left_semi"), here, callouts.join(todo, "page_id", "left_semi"), pages)
    new = ["box", "width_ft", "height_ft", "area_sqft", "perimeter_ft", "warning"]
    joined = rows.join(found.select("page_id", "label_id", F.struct(*new).alias("z")), ["page_id", "label_id"], "left")
    shared = c("z").isNotNull()
    joined = joined.withColumns({n: F.when(shared, c(f"z.{n}")).otherwise(c(n)) for n in new})
    return joined.withColumn("polygon", F.when(shared, _box_polygon()).otherwise(c("polygon"))).withColumn(
        "derivation", F.when(shared, "virtual-partition").otherwise(c("derivation")))


# --- driver (J11) ---------------------------------------------------------------------------------------------
def extract_rooms(fragments: DataFrame, segs: DataFrame, faces: DataFrame, scales: DataFrame, path_ops: DataFrame,
                  plan_areas: DataFrame, min_walls: int = MIN_WALLS, min_rows: int = MIN_TABLE_ROWS,
                  ) -> tuple[DataFrame, DataFrame]:
    """Rooms and one status row per page: skipped early, by table, by geometry, or too little geometry.

    ``reason`` of a page without rooms: no_text_layer, non_floor_plan, few_table_rows (a printed table below ``min_rows``
    and no room by geometry), few_walls (below ``min_walls``) or low_geometry (walls but no room).  The status also
    counts the page's text fragments, printed rows, walls and faces.
    """
    fragments = cut(txt.read_text(fragments))
    skips = cut(txt.page_skips(fragments, path_ops))
    return _extract(fragments, segs, faces, scales, skips, plan_areas, min_walls, min_rows)


def _extract(fragments: DataFrame, segs: DataFrame, faces: DataFrame, scales: DataFrame, skips: DataFrame, plan_areas: DataFrame,
             min_walls: int, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """``extract_rooms`` for pages whose ``skips`` (page_skips) are known."""
    # page lists pack into small files but are long: they are shuffled, not broadcast by the size of their file
    open_pages = skips.where(c("skip").isNull()).select("page_id").hint("merge")
    readable = cut(fragments.join(open_pages, "page_id", "left_semi"))
    listed = cut(txt.dim_rows(readable))
    a = cut(table_rooms(readable, faces, scales, plan_areas, min_rows, listed))
    by_table = cut(a.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where(c("n") >= min_rows).select("page_id")).hint("merge")
    # both are read by many steps of the second strategy, each of which would sift them anew; walls of skipped pages serve none
    left = cut(readable.join(by_table, "page_id", "left_anti"))
    drawn = cut(segs.select("page_id", "seg_id", "x1", "y1", "x2", "y2").join(open_pages, "page_id", "left_semi").join(
        by_table, "page_id", "left_anti"))
    b = cut(vector_rooms(left, drawn, faces.where(c("area") >= VECTOR_FACE), scales, cut(txt.callouts(left)), min_walls))
    rooms = a.join(by_table, "page_id", "left_semi").withColumn("strategy", F.lit("table")).unionByName(
        b.withColumn("strategy", F.lit("vector")))
    done = rooms.select("page_id", "strategy").distinct()
    number = lambda df, name: df.groupBy("page_id").agg(F.count(F.lit(1)).alias(name))
    status = skips.join(done, "page_id", "left")
    for df, name in ((fragments, "fragments"), (listed, "table_rows"), (segs, "walls"), (faces, "faces")):
        status = status.join(number(df, name), "page_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    few = (F.when((c("table_rows") > 0) & (c("table_rows") < min_rows), "few_table_rows")
           .when(c("walls") < min_walls, "few_walls").otherwise("low_geometry"))
    return rooms, status.select(
        "page_id", F.when(c("strategy").isNotNull(), "ok").otherwise("skipped").alias("status"),
        F.coalesce("strategy", F.lit("none")).alias("strategy"),
        F.when(c("strategy").isNull(), F.coalesce("skip", few)).alias("reason"), "fragments", "table_rows", "walls", "faces")


def extract_from_segments(fragments: DataFrame, segs: DataFrame, scales: DataFrame, path_ops: DataFrame,
                          plan_areas: DataFrame, doors: DataFrame | None = None, min_walls: int = MIN_WALLS,
                          min_rows: int = MIN_TABLE_ROWS) -> tuple[DataFrame, DataFrame]:
    """``extract_rooms`` from wall segments: both strategies' faces come from one job over all pages.

    The strategies differ in nothing but the least face (``TABLE_FACE``, ``VECTOR_FACE``), so the graph is walked once
    for the smaller one; pages that are skipped early, or whose walls could close no face, are not walked.
    """
    # callers' inputs are often joins themselves and feed many steps: they are worked out once
    fragments, segs = cut(txt.read_text(fragments)), cut(segs.select("page_id", "seg_id", "x1", "y1", "x2", "y2"))
    skips = cut(txt.page_skips(fragments, path_ops))
    walled = segs.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where(c("n") >= 4).select("page_id")
    todo = skips.where(c("skip").isNull()).select("page_id").hint("merge").join(walled, "page_id", "left_semi")
    drawn = cut(segs.join(todo, "page_id", "left_semi"))
    faces = cut(room_faces(drawn, _page_sizes(fragments), doors, snap=1.5, max_gap=60.0, door_radius=30.0, min_area=TABLE_FACE,
                           max_area=float("inf"), max_aspect=30.0, max_vertices=80).select("page_id", "face", "area", "box", "polygon"))
    return _extract(fragments, segs, faces, scales, skips, plan_areas, min_walls, min_rows)


# --- candidates (J12) --------------------------------------------------------------------------------------------
def room_candidates(fragments: DataFrame, faces: DataFrame, scales: DataFrame, callouts: DataFrame) -> DataFrame:
    """Label clusters with their smallest face, measurement source and confidence."""
    words = fragments.where(X.is_candidate_room(c("text"))).select("page_id", "seq", "text", "x", "y", "width", "height")
    labels = cut(geo.label_clusters(words, in_list_order=True))
    hit = geo.enclosing_face(labels.select("page_id", c("label_id").alias("point_id"), c("cx").alias("x"), c("cy").alias("y")), faces)
    shape = faces.select("page_id", "face", "box", "polygon")
    placed = cut(labels.join(hit.select("page_id", c("point_id").alias("label_id"), "face"), ["page_id", "label_id"], "left")
                 .join(shape, ["page_id", "face"], "left"))
    shared = geo.shared_faces(placed.where(c("face").isNotNull()).select("page_id", "face", c("label_id").alias("ord"))).select(
        "page_id", c("ord").alias("label_id"), "shared")
    around = F.struct((c("cx") - 40).alias("x0"), (c("cy") - 30).alias("y0"), (c("cx") + 40).alias("x1"), (c("cy") + 30).alias("y1"))
    rows = placed.join(shared, ["page_id", "label_id"], "left").join(scales.select("page_id", "pt_per_foot"), "page_id", "left").withColumn(
        "box", F.coalesce("box", around))
    faced = rows.where(c("face").isNotNull()).select("page_id", c("label_id").alias("room_id"), "box", "pt_per_foot")
    dims = geo.room_dimensions(faced.where(c("pt_per_foot") > 0), geo.room_callouts(faced.drop("pt_per_foot"), callouts, 30.0)).select(
        "page_id", c("room_id").alias("label_id"), "width_ft", "height_ft", "area_sqft", "source")
    loose = rows.where(c("face").isNull()).select("page_id", c("label_id").alias("room_id"), "box")
    largest = (geo.room_callouts(loose, callouts, 60.0).groupBy("page_id", c("room_id").alias("label_id")).agg(
        F.max(F.when(c("orientation") == "h", c("length_ft"))).alias("lw"), F.max(F.when(c("orientation") == "v", c("length_ft"))).alias("lh"))
        .where(c("lw").isNotNull() & c("lh").isNotNull()))
    out = rows.join(dims, ["page_id", "label_id"], "left").join(largest, ["page_id", "label_id"], "left")
    w, h = c("box.x1") - c("box.x0"), c("box.y1") - c("box.y0")
    has_face = c("face").isNotNull()
    source = (F.when(has_face & c("source").isNull(), "none").when(has_face & (c("source") == "bbox"), "geometry+scale")
              .when(has_face, c("source")).when(c("lw").isNotNull(), "callouts").otherwise("none"))
    base = (F.lit(0.85) - F.when(c("shared"), 0.25).otherwise(0.0) - F.when(F.greatest(w / h, h / w) > 15, 0.15).otherwise(0.0)
            - F.when(F.size("polygon") > 30, 0.1).otherwise(0.0))
    confidence = (F.when(~has_face, F.when(c("lw").isNotNull(), 0.7).otherwise(0.25))
                  .when(c("measured_by") == "callouts", F.least(F.lit(0.99), base + 0.1)).otherwise(base))
    return (out.withColumn("measured_by", source).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))
            .select("page_id", "label_id", c("text").alias("label"), "face", "box", F.coalesce("width_ft", "lw").alias("width_ft"),
                    F.coalesce("height_ft", "lh").alias("height_ft"), F.coalesce(c("area_sqft"), c("lw") * c("lh")).alias("area_sqft"),
                    "measured_by", "confidence"))
