"""Plan text as sets: callouts, scales, dimension tables, labels, title blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.session import cut
from plumbline.functions import plantext as X

c = F.col
#: Fewest text pieces and drawing operations of a readable page; fewest distinct labels along a scale bar.
MIN_FRAGMENTS = 3
MIN_PATH_OPS = 80
MIN_BAR_LABELS = 3


def read_text(fragments: DataFrame) -> DataFrame:
    """Adds what each text says: ``_d``, the dimensions it states, and ``_room``, whether a room may be called so.

    Fragments that have these columns keep them, so jobs of many steps read every text once.
    """
    if "_d" in fragments.columns:
        return fragments
    return fragments.withColumns({"_d": X.parse_dim(c("text")), "_room": X.is_table_room(c("text"))})


def callouts(fragments: DataFrame) -> DataFrame:
    """Fragments that state one length, with orientation."""
    return (fragments.withColumn("_p", X.parse_callout(c("text"))).where(c("_p").isNotNull())
            .select("page_id", "seq", "text", "x", "y", "_p.length_ft", "_p.confidence",
                    X.orientation(c("rotation")).alias("orientation")))


# --- scales --------------------------------------------------------------------------------------
def scale_anchor(fragments: DataFrame) -> DataFrame:
    """Best printed scale per page.

    A lone ``SCALE`` takes its value from one of the next two fragments.  Neighbours are found by an
    equality join on the reading position, so no page is ever sorted in one task.  ``seq`` is the
    gap-free reading position.
    """
    read = (fragments.withColumn("_i", X.imperial_scale(c("text"))).withColumn("_m", X.metric_scale(c("text")))
            .select("page_id", "seq", "text", "_i", "_m"))
    own = read.select("page_id", "seq", F.posexplode(F.array("_i", "_m")).alias("step", "s")).where(c("s").isNotNull())
    lone = (read.where(F.trim("text").rlike(r"(?i)^scale\s*:?\s*$"))
            .select("page_id", "seq", F.explode(F.array(F.lit(1), F.lit(2))).alias("_off")))
    ahead = (lone.withColumn("_at", c("seq") + c("_off"))
             .join(read.where(F.coalesce("_i", "_m").isNotNull())
                   .select("page_id", c("seq").alias("_at"), F.coalesce("_i", "_m").alias("s")), ["page_id", "_at"])
             .groupBy("page_id", "seq").agg(F.min_by("s", "_off").alias("s"))
             .withColumn("s", c("s").withField("confidence", F.least(F.lit(0.99), c("s.confidence") + 0.1)))
             .select("page_id", "seq", F.lit(2).alias("step"), "s"))
    best = own.unionByName(ahead).groupBy("page_id").agg(
        F.max_by(F.struct("seq", "s"), F.struct(c("s.confidence"), -c("seq"), -c("step"))).alias("b"))
    return best.select("page_id", c("b.seq").alias("seq"), "b.s.*")


def scale_bar(fragments: DataFrame) -> DataFrame:
    """Best graphic scale bar per page (F3): evenly spaced foot labels on one line.

    Lines are found by gaps of more than 6 pt among the distinct transverse positions; labels of one
    line are then compared with their neighbours.  A label that repeats its neighbour's value within
    1 pt is dropped.
    """
    labels = fragments.withColumn("ft", X.feet_label(c("text"))).where(c("ft").isNotNull())
    sides = F.explode(F.array(
        F.struct(F.lit("horizontal").alias("o"), c("x").alias("along"), c("y").alias("across")),
        F.struct(F.lit("vertical").alias("o"), c("y").alias("along"), c("x").alias("across"))))
    pts = labels.select("page_id", "ft", sides.alias("s")).select("page_id", "ft", "s.*")
    page = Window.partitionBy("page_id", "o").orderBy("across")
    lines = (pts.select("page_id", "o", "across").distinct()
             .withColumn("_new", (c("across") - F.lag("across").over(page) > 6).cast("int"))
             .withColumn("line", F.sum(F.coalesce("_new", F.lit(0))).over(page)).drop("_new"))
    along = Window.partitionBy("page_id", "o", "line").orderBy("along", "ft")
    kept = (pts.join(lines, ["page_id", "o", "across"])
            .withColumn("_pa", F.lag("along").over(along)).withColumn("_pf", F.lag("ft").over(along))
            .where(c("_pa").isNull() | (c("along") - c("_pa") >= 1) | (c("_pf") != c("ft")))
            .withColumn("_pa", F.lag("along").over(along)).withColumn("_pf", F.lag("ft").over(along))
            .withColumn("ratio", F.when(c("ft") > c("_pf"), (c("along") - c("_pa")) / (c("ft") - c("_pf"))))
            .withColumn("ratio", F.when(c("ratio") > 0, c("ratio"))))
    key = ["page_id", "o", "line"]
    ends = lambda fn: fn(F.struct("along", "ft"))
    stats = (kept.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("ft").alias("values"), F.max("ft").alias("top"),
        ends(F.min).alias("a"), ends(F.max).alias("b"), F.count("ratio").alias("ratios"),
        F.median("ratio").alias("pt"), F.min("ft").alias("low"))
        .where((c("n") >= MIN_BAR_LABELS) & (c("values") >= MIN_BAR_LABELS) & (c("top") >= 4) & (c("b.along") - c("a.along") >= 30)
               & (c("b.ft") - c("a.ft") >= 4) & (c("ratios") >= 2) & c("pt").between(1, 200)))
    spread = F.abs(c("ratio") - c("pt")) / c("pt")
    residual = F.abs(c("a.along") + (c("ft") - c("a.ft")) * c("pt") - c("along"))
    checked = (kept.join(stats.select(*key, "pt", "a", "b", "low", "top"), key)
               .groupBy(*key, "pt", "a", "b", "low", "top")
               .agg(F.max(spread).alias("spread"), F.max(residual).alias("residual"))
               .where((c("spread") <= 0.15) & (c("residual") <= (c("b.along") - c("a.along")) * 0.15)))
    feet = (c("b.ft") - c("a.ft")).cast("double")
    steady = F.when(c("spread") == 0, 0.0001).otherwise(c("spread"))
    confidence = F.least(F.lit(0.95), F.lit(0.55) + F.least(F.lit(0.25), feet / 64)
                         + F.least(F.lit(0.15), F.lit(0.15) - steady))
    hits = checked.withColumn("confidence", confidence).withColumn(
        "label", F.concat(F.lit("Scale bar: "), c("a.ft").cast("string"), F.lit("–"), c("b.ft").cast("string"),
                          F.lit(" ft")))
    best = F.struct((c("top") - c("low")), c("confidence"), (c("o") == "horizontal"), -c("line"))
    return (hits.groupBy("page_id").agg(F.max_by(F.struct(c("pt").alias("pt_per_foot"), "label", "confidence",
                                                          c("o").alias("orientation")), best).alias("b"))
            .select("page_id", "b.*"))


#: Most distinct values of a group that one task orders, and the bins of a round of selection.
ORDERED_VALUES, BINS = 1 << 16, 1024


def value_at(df: DataFrame, group: list[str], value: str, index: Column, name: str, limit: int = ORDERED_VALUES) -> DataFrame:
    """The value at a 0-based position of each group's ascending order; ``index`` may use ``n``.

    Equal values are counted first.  Groups of more than ``limit`` distinct values are narrowed by rounds: the values
    still in question are counted by sign and power of two, or, once these agree, in ``BINS`` equal bins between the
    least and the largest; only the bin that holds the position stays.  Both ends fall into different bins, so every
    round narrows and about seven suffice; a task orders at most ``limit`` values or the bins of a group.
    """
    def power(v: Column) -> Column:  # rises with the value
        return F.when(v == 0, 0).otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v))) + 1100)).cast("int")

    counts = cut(df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_m")))
    least, most = F.min(value).alias("_lo"), F.max(value).alias("_hi")
    sizes = counts.groupBy(*group).agg(F.sum("_m").alias("n"), F.count(F.lit(1)).alias("_d"), least, most).withColumn(
        "_i", index.cast("bigint"))
    asked, rest = cut(sizes), counts
    wide = lambda: asked.where(c("_d") > limit)
    while not wide().isEmpty():
        inside = rest.join(wide(), group).where(c(value).between(c("_lo"), c("_hi")))
        share = (c(value) - c("_lo")) / (c("_hi") - c("_lo"))
        bin_ = F.when(power(c("_lo")) != power(c("_hi")), power(c(value))).otherwise(
            F.least(F.floor(share * BINS).cast("int"), F.lit(BINS - 1))).alias("_bin")
        bins = inside.groupBy(*group, bin_, "n", "_i").agg(F.sum("_m").alias("_s"), F.count(F.lit(1)).alias("_d"), least, most)
        order = Window.partitionBy(*group).orderBy("_bin")
        chosen = (bins.withColumn("_upto", F.sum("_s").over(order)).where((c("_upto") > c("_i")) & (c("_upto") - c("_s") <= c("_i")))
                  .withColumn("_i", c("_i") - (c("_upto") - c("_s"))).select(*asked.columns))
        asked = cut(asked.where(c("_d") <= limit).unionByName(chosen))
        rest = cut(rest.join(asked.select(*group, "_lo", "_hi"), group).where(c(value).between(c("_lo"), c("_hi"))).select(*counts.columns))
    order = Window.partitionBy(*group).orderBy(value)
    return (rest.join(asked, group).where(c(value).between(c("_lo"), c("_hi"))).withColumn("_upto", F.sum("_m").over(order))
            .where((c("_upto") > c("_i")) & (c("_upto") - c("_m") <= c("_i")))
            .select(*group, c(value).alias(name), "n"))


def verify_scale(doors: DataFrame, scales: DataFrame) -> DataFrame:
    """Door widths against the scale (E18): trimmed upper median, expected 3 ft.

    ``doors``: page_id, size in points; ``scales``: page_id, pt_per_foot.
    """
    cut10 = F.floor(c("n") * 0.1)
    middle = value_at(doors, ["page_id"], "size", cut10 + F.floor((c("n") - 2 * cut10) / 2), "median_pt")
    out = scales.join(middle, "page_id", "left").withColumn("doors", F.coalesce("n", F.lit(0))).drop("n")
    enough = c("doors") >= 3
    implied = F.when(enough, c("median_pt") / c("pt_per_foot"))
    error = c("implied_ft") / 3.0
    status = (F.when(~enough, "insufficient_data").when(error.between(0.85, 1.15), "verified")
              .when(error.between(0.7, 1.4), "weak").otherwise("mismatch"))
    return (out.withColumn("implied_ft", implied).withColumn("check", status)
            .withColumn("suggested_pt_per_foot", F.when(c("check") == "mismatch", c("median_pt") / 3.0)))


def establish_scale(fragments: DataFrame, doors: DataFrame, user: DataFrame) -> DataFrame:
    """One scale per page: set by the user, else printed, else a scale bar, checked by doors.

    ``user``: page_id, pt_per_foot, label.  Pages without any source are absent.
    """
    cols = ["page_id", "pt_per_foot", "label", "confidence"]
    mine = user.where(c("pt_per_foot") > 0).select("page_id", "pt_per_foot", "label", F.lit(0.99).alias("confidence"))
    ranked = [(mine, "user", 0), (scale_anchor(fragments).select(*cols), "text-notation", 1),
              (scale_bar(fragments).select(*cols), "scale-bar", 2)]
    both = None
    for df, method, rank in ranked:
        part = df.select(*cols, F.lit(method).alias("method"), F.lit(rank).alias("rank"))
        both = part if both is None else both.unionByName(part)
    first = both.groupBy("page_id").agg(
        F.min_by(F.struct("pt_per_foot", "label", "confidence", "method"), "rank").alias("s")).select("page_id", "s.*")
    checked = verify_scale(doors, first)
    text, bar, conf = c("method") == "text-notation", c("method") == "scale-bar", c("confidence")
    verified, bad = c("check") == "verified", c("check") == "mismatch"
    adjusted = (F.when(text & verified, F.least(F.lit(0.99), conf + 0.05))
                .when(text & bad, F.greatest(F.lit(0.2), conf - 0.4))
                .when(bar & verified, F.least(F.lit(0.95), conf + 0.05))
                .when(bar & bad, F.greatest(F.lit(0.2), conf - 0.3)).otherwise(conf))
    return checked.select("page_id", "pt_per_foot", "label", "method", adjusted.alias("confidence"), "check")


# --- dimension tables ------------------------------------------------------------------------------
def _near_rows(left: DataFrame, right: DataFrame, tol: float) -> DataFrame:
    """Pairs (l_*, r_*) on one page whose y differs by at most ``tol``: an equality join on bands."""
    band = lambda y: F.floor(y / F.lit(tol)).cast("bigint")
    a = left.select(*[c(n).alias("l_" + n) for n in left.columns]).withColumn(
        "_band", F.explode(F.array(*[band(c("l_y")) + k for k in (-1, 0, 1)])))
    b = right.select(*[c(n).alias("r_" + n) for n in right.columns]).withColumn("_band", band(c("r_y")))
    return a.join(b, (c("l_page_id") == c("r_page_id")) & (a["_band"] == b["_band"])
                  & (F.abs(c("l_y") - c("r_y")) <= tol)).drop("_band")


def _dims(fragments: DataFrame) -> DataFrame:
    return (read_text(fragments).where(c("_d").isNotNull())
            .select("page_id", "seq", "x", "y", "width", "height", "page_w", "page_h", "_d.width_ft", "_d.height_ft"))


def dim_rows(fragments: DataFrame) -> DataFrame:
    """Printed room dimensions with the nearest label on their left (D21); first per label."""
    labels = read_text(fragments).where(c("_d").isNull() & ~X.is_header(c("text"))).select(
        "page_id", "seq", "text", "x", "y", "width")
    gap = c("l_x") - (c("r_x") + c("r_width"))
    pairs = (_near_rows(_dims(fragments), labels, 5.0).where((c("r_x") < c("l_x")) & (gap >= 0))
             .groupBy(c("l_page_id").alias("page_id"), c("l_seq").alias("seq"),
                      c("l_width_ft").alias("width_ft"), c("l_height_ft").alias("height_ft"))
             .agg(F.min_by(F.struct(F.trim("r_text").alias("label"), c("r_seq").alias("label_seq")),
                           F.struct(gap, c("r_seq"))).alias("b")))
    rows = pairs.select("page_id", "seq", "width_ft", "height_ft", "b.*").withColumn(
        "area_sqft", F.floor(c("width_ft") * c("height_ft") * 10 + 0.5) / 10)
    first = rows.groupBy("page_id", F.lower("label").alias("_k")).agg(
        F.min_by(F.struct("seq", "label", "label_seq", "width_ft", "height_ft", "area_sqft"), "seq").alias("r"))
    return first.select("page_id", "r.*")


def dim_table_box(fragments: DataFrame) -> DataFrame:
    """Box of a dimension schedule, if its fragments stay within 12 % of the page.

    Labels on a row of the schedule and over its columns widen the box; the columns are those of
    the dimension fragments themselves.
    """
    dims = _dims(fragments)
    box = (dims.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max(c("x") + c("width")).alias("x1"),
        F.min("y").alias("y0"), F.max(c("y") + c("height")).alias("y1"),
        F.max(c("page_w") * c("page_h")).alias("page_area"))
        .where((c("n") >= 2) & ((c("x1") - c("x0")) * (c("y1") - c("y0")) <= c("page_area") * 0.12)))
    others = read_text(fragments).where(c("_d").isNull()).select("page_id", "seq", "x", "y", "width", "height")
    rows = (_near_rows(dims.join(box.select("page_id"), "page_id", "left_semi").select("page_id", "y"), others, 3.0)
            .select(c("r_page_id").alias("page_id"), "r_seq", "r_x", "r_y", "r_width", "r_height").distinct()
            .join(box.select("page_id", "x0", "x1"), "page_id")
            .where((c("r_x") + c("r_width") > c("x0")) & (c("r_x") < c("x1")))
            .groupBy("page_id").agg(F.min("r_x").alias("lx"), F.min("r_y").alias("ly"),
                                    F.max(c("r_y") + c("r_height")).alias("lt")))
    return box.join(rows, "page_id", "left").select(
        "page_id", (F.least("x0", "lx") - 4).alias("x0"), (F.least("y0", "ly") - 4).alias("y0"),
        (c("x1") + 4).alias("x1"), (F.greatest("y1", "lt") + 4).alias("y1"))


def sizing_hint(rows: DataFrame, plan_areas: DataFrame) -> DataFrame:
    """Points per foot that would make the table's rooms fill 60 % of the plan (E22); drawing only."""
    total = rows.groupBy("page_id").agg(F.sum(c("width_ft") * c("height_ft")).alias("_a"))
    return (total.where(c("_a") > 0).join(plan_areas, "page_id")
            .select("page_id", F.sqrt(c("plan_area") * 0.6 / c("_a")).alias("pt_per_foot")))


# --- labels --------------------------------------------------------------------------------------
def _norm(df: DataFrame) -> DataFrame:
    """Normalised, y-down positions."""
    return df.withColumn("x_norm", c("x") / c("page_w")).withColumn("y_norm", 1 - c("y") / c("page_h"))


def title_strips(fragments: DataFrame) -> DataFrame:
    """Pages whose title block fills the right or the bottom strip."""
    hits = _norm(fragments).where(X.is_title_word(c("text")))
    out = hits.groupBy("page_id").agg(F.count(F.lit(1)).alias("hits"), F.count_if(c("x_norm") > 0.7).alias("r"),
                                      F.count_if(c("y_norm") > 0.78).alias("b")).where(c("hits") >= 2)
    need = F.ceil(c("hits") * 0.4)
    return out.select("page_id", (c("r") >= need).alias("right_strip"), (c("b") >= need).alias("bottom_strip"))


def pick_labels(fragments: DataFrame) -> DataFrame:
    """Possible room labels outside margins, codes and title-block strips."""
    kept = _norm(fragments).where(X.may_be_label(c("text"), c("x_norm"), c("y_norm")))
    strips = title_strips(fragments)
    blocked = (F.coalesce("right_strip", F.lit(False)) & (c("x_norm") >= 0.7)) | (
        F.coalesce("bottom_strip", F.lit(False)) & (c("y_norm") >= 0.78))
    return kept.join(strips, "page_id", "left").where(~blocked).drop("right_strip", "bottom_strip")


def page_skips(fragments: DataFrame, path_ops: DataFrame, min_fragments: int = MIN_FRAGMENTS,
               min_ops: int = MIN_PATH_OPS) -> DataFrame:
    """Why a page cannot be measured, or NULL (C21), a row for every page; ``path_ops``: page_id, ops.

    A page with fewer text pieces than ``min_fragments`` and fewer drawing operations than ``min_ops`` is an image.
    """
    facts = read_text(fragments).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("_room").alias("rooms"))
    reason = (F.when((F.coalesce("n", F.lit(0)) < min_fragments) & (F.coalesce("ops", F.lit(0)) < min_ops), "no_text_layer")
              .when(F.coalesce("rooms", F.lit(0)) == 0, "non_floor_plan"))
    return facts.join(path_ops, "page_id", "full_outer").select("page_id", reason.alias("skip"))
