"""Matching detections to ground truth and error metrics.

Input rows are ``plan_id, ord, label, area`` (``ord`` a whole number giving list order).  Labels
repeat heavily, so every comparison is made once per pair of distinct labels of a plan and only then
brought back to rows; candidate pairs come from equality joins on tokens or short character runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import text as T
from plumbline.operators.ordered import running_total
from plumbline.operators.plantext import value_at
from plumbline.session import cut

c = F.col
FEW_BEGINNINGS = 256


def _labels(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.select("plan_id", key.alias(name)).distinct()


# --- greedy one-to-one (D15) -------------------------------------------------------------------
def _pieces(tokens: Column) -> Column:
    """A token and all its substrings of at least four characters."""
    subs = F.flatten(F.transform(tokens, lambda t: F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(t)), lambda i: F.transform(
            F.sequence(F.lit(4), F.greatest(F.lit(4), F.length(t) - i + 1)), lambda n: F.substr(t, i, n))))))
    return F.array_distinct(F.filter(F.concat(tokens, subs), lambda s: F.length(s) >= 3))


def _score_labels(truth: DataFrame, cand: DataFrame) -> DataFrame:
    """Scored pairs of label classes that share a token or contain one another's long tokens."""
    def classes(df: DataFrame, cls: str, tok: str) -> DataFrame:
        return df.select("plan_id", c("cls").alias(cls), c("tokens").alias(tok)).distinct()
    t, d = classes(truth, "a", "ta"), classes(cand, "b", "tb")
    # substrings carry the length test: a whole token always matches itself, a part needs four letters
    def linked(left: DataFrame, lt: str, right: DataFrame, rt: str) -> DataFrame:
        x = left.withColumn("_k", F.explode(lt))
        y = right.withColumn("_k", F.explode(_pieces(c(rt))))
        return x.join(y, ["plan_id", "_k"]).where(
            F.array_contains(rt, c("_k")) | (F.length("_k") >= 4)).select("plan_id", "a", "b", "ta", "tb")
    pairs = linked(t, "ta", d, "tb").unionByName(linked(d, "tb", t, "ta")).dropDuplicates(["plan_id", "a", "b"])
    return pairs.select("plan_id", "a", "b", T.jaccard(c("ta"), c("tb")).alias("score"))


def _classed(df: DataFrame, width: int) -> DataFrame:
    tokens = F.array_sort(F.array_distinct(T.label_tokens(T.plain_label(c("label")), T.SCORED_STOP_WORDS)))
    rows = df.withColumn("tokens", tokens).where(F.size("tokens") > 0).withColumn("cls", F.array_join("tokens", " "))
    return running_total(rows, ["plan_id", "cls"], "ord", "ord", F.lit(1), width, "rank")


def match_greedy(truth: DataFrame, cand: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Best-scored pairs first, each row used once: plan_id, truth_ord, cand_ord, score.

    Equal scores go by truth order, then candidate order.  Each round takes every pair of label
    classes that are each other's best and pairs off their rows in order for as long as no equally
    good class has an earlier row, so long runs of equal labels take one round.
    """
    t_left = cut(_classed(truth, width).select("plan_id", c("cls").alias("a"), c("ord").alias("i"), "rank"))
    c_rows = _classed(cand.where(c("area").isNotNull()), width)
    c_left = cut(c_rows.select("plan_id", c("cls").alias("b"), c("ord").alias("j"), "rank"))
    scores = cut(_score_labels(_classed(truth, width), c_rows))
    matched: DataFrame | None = None
    while True:
        heads_t = t_left.groupBy("plan_id", "a").agg(F.min("i").alias("hi"), F.min("rank").alias("ri"))
        heads_c = c_left.groupBy("plan_id", "b").agg(F.min("j").alias("hj"), F.min("rank").alias("rj"))
        live = cut(scores.join(heads_t, ["plan_id", "a"]).join(heads_c, ["plan_id", "b"]))
        for_a = live.groupBy("plan_id", "a").agg(
            F.max(F.struct("score", -c("hj"), "b")).alias("x")).select("plan_id", "a", c("x.b").alias("b"))
        for_b = live.groupBy("plan_id", "b").agg(
            F.max(F.struct("score", -c("hi"), "a")).alias("x")).select("plan_id", "b", c("x.a").alias("a"))
        mutual = live.join(for_a, ["plan_id", "a", "b"]).join(for_b, ["plan_id", "a", "b"])
        rival_b = live.select("plan_id", "a", "score", c("b").alias("_b"), c("hj").alias("_hj"))
        rival_a = live.select("plan_id", "b", "score", c("a").alias("_a"), c("hi").alias("_hi"))
        stop_j = (mutual.join(rival_b, ["plan_id", "a", "score"]).where(c("_b") != c("b"))
                  .groupBy("plan_id", "a", "b").agg(F.min("_hj").alias("stop_j")))
        stop_i = (mutual.join(rival_a, ["plan_id", "b", "score"]).where(c("_a") != c("a"))
                  .groupBy("plan_id", "a", "b").agg(F.min("_hi").alias("stop_i")))
        runs = cut(mutual.join(stop_j, ["plan_id", "a", "b"], "left").join(stop_i, ["plan_id", "a", "b"], "left"))
        ti = (t_left.join(runs, ["plan_id", "a"]).where(c("stop_i").isNull() | (c("i") < c("stop_i")))
              .select("plan_id", "a", "b", (c("rank") - c("ri")).alias("k"), "i", "score"))
        cj = (c_left.join(runs, ["plan_id", "b"]).where(c("stop_j").isNull() | (c("j") < c("stop_j")))
              .select("plan_id", "a", "b", (c("rank") - c("rj")).alias("k"), "j"))
        new = cut(ti.join(cj, ["plan_id", "a", "b", "k"]).select("plan_id", "i", "j", "score"))
        if new.isEmpty():
            out = new if matched is None else matched
            return out.select("plan_id", c("i").alias("truth_ord"), c("j").alias("cand_ord"), "score")
        matched = new if matched is None else cut(matched.unionByName(new))
        t_left = cut(t_left.join(new.select("plan_id", "i"), ["plan_id", "i"], "left_anti"))
        c_left = cut(c_left.join(new.select("plan_id", "j"), ["plan_id", "j"], "left_anti"))


# --- yes/no label matching (D13, D14, D16) -----------------------------------------------------
def grams(text: Column) -> Column:
    """Every run of one to three characters."""
    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1)))
        return F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))
    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


def spots(inner: DataFrame, outer: DataFrame, outer_col: str, most: int = FEW_BEGINNINGS) -> DataFrame:
    """Outer rows once for each beginning ``_k`` of their plan's inner rows that they contain.

    Plans of more than ``most`` beginnings spread their texts over all short runs instead, so no text is tried on many.
    """
    starts = inner.groupBy("plan_id").agg(F.collect_set("_k").alias("_ks"))
    held = F.filter("_ks", lambda k: F.contains(c(outer_col), k))
    return outer.join(starts, "plan_id").withColumn(
        "_k", F.explode(F.when(F.size("_ks") <= most, held).otherwise(grams(c(outer_col))))).drop("_ks")


def _contained(inner: DataFrame, inner_col: str, outer: DataFrame, outer_col: str) -> DataFrame:
    """Pairs of one plan where the inner text occurs in the outer one, found by its first characters."""
    x = inner.where(c(inner_col) != "").withColumn("_k", F.substring(inner_col, 1, 3))
    return (x.join(spots(x, outer, outer_col), ["plan_id", "_k"])
            .where(F.contains(c(outer_col), c(inner_col))).drop("_k"))


def _detected(cand: DataFrame, key: Column) -> DataFrame:
    return (cand.groupBy("plan_id", key.alias("dl"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("area", F.lit(0.0))).alias("total"),
                 F.max("area").alias("largest")))


def _by_truth(truth: DataFrame, truth_key: Column, pairs: DataFrame, detected: DataFrame) -> DataFrame:
    """Per truth row: how many detections matched, their summed and their largest area."""
    hits = (pairs.select("plan_id", "tl", "dl").distinct().join(detected, ["plan_id", "dl"])
            .groupBy("plan_id", "tl").agg(F.sum("n").alias("hits"), F.sum("total").alias("total"),
                                          F.max("largest").alias("largest")))
    return (truth.withColumn("tl", truth_key).join(hits, ["plan_id", "tl"], "left").drop("tl")
            .withColumn("hits", F.coalesce("hits", F.lit(0))))


def match_fuzzy(truth: DataFrame, cand: DataFrame) -> DataFrame:
    """Equal, one inside the other, or the shorter token set inside the longer."""
    key = T.plain_label(c("label"), drop_notes=False)
    detected = cut(_detected(cand, key))
    t, d = cut(_labels(truth, key, "tl").where(c("tl") != "")), detected.select("plan_id", "dl").where(c("dl") != "")
    inside = _contained(t, "tl", d, "dl").select("plan_id", "tl", "dl").unionByName(
        _contained(d, "dl", t, "tl").select("plan_id", "tl", "dl"))
    tokens = lambda name: F.array_distinct(T.label_tokens(c(name), T.FUZZY_STOP_WORDS))
    tt, dt = t.withColumn("tt", tokens("tl")), d.withColumn("dt", tokens("dl"))
    shared = (tt.withColumn("_k", F.explode("tt")).join(dt.withColumn("_k", F.explode("dt")), ["plan_id", "_k"])
              .where(F.size(F.array_intersect("tt", "dt")) >= F.least(F.size("tt"), F.size("dt")))
              .select("plan_id", "tl", "dl"))
    return _by_truth(truth, key, inside.unionByName(shared), detected)


def match_keys(truth: DataFrame, cand: DataFrame) -> DataFrame:
    """Detections whose label contains any of the truth row's ``match_keys``."""
    keys = truth.select("plan_id", "label", F.explode("match_keys").alias("_m")).select(
        "plan_id", c("label").alias("tl"), F.lower("_m").alias("key")).distinct()
    detected = cut(_detected(cand, F.lower("label")))
    pairs = _contained(keys, "key", detected.select("plan_id", "dl"), "dl")
    return _by_truth(truth, c("label"), pairs, detected)


def match_largest(truth: DataFrame, cand: DataFrame) -> DataFrame:
    """Largest detection containing the truth label, or whose first word the truth label contains."""
    fold = F.trim(F.regexp_replace(F.regexp_replace(F.lower("label"), r"\s+", " "), "[^a-z0-9 ]", ""))
    detected = cut(_detected(cand, fold))
    t, d = cut(_labels(truth, fold, "tl")), detected.select("plan_id", "dl")
    first = d.withColumn("fw", F.substring_index("dl", " ", 1))
    pairs = _contained(t, "tl", d, "dl").select("plan_id", "tl", "dl").unionByName(
        _contained(first, "fw", t, "tl").select("plan_id", "tl", "dl"))
    return _by_truth(truth, fold, pairs, detected)


# --- metrics -------------------------------------------------------------------------------------
def rectangle_facts(width: Column, height: Column, ceiling: Column) -> Column:
    perimeter = (width + height) * 2
    return F.struct(perimeter.alias("perimeter"), (perimeter * ceiling).alias("wall_area"),
                    (width * height).alias("floor_area"))


def accuracy(scored: DataFrame, by: list[str]) -> DataFrame:
    """Error metrics of ``scored`` = by..., truth_area, measured (NULL when not matched).

    The median is the upper middle of the absolute errors.
    """
    err = F.abs(c("measured") - c("truth_area")) / c("truth_area") * 100
    rows = scored.withColumn("err", err)
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rooms"), F.count("measured").alias("matched"), F.avg("err").alias("mae"),
        F.count_if(c("err") <= 10).alias("within_10"), F.count_if(c("err") <= 20).alias("within_20"),
        F.sum("truth_area").alias("truth_total"), F.sum(F.coalesce("measured", F.lit(0.0))).alias("measured_total"))
    middle = value_at(rows.where(c("err").isNotNull()), by, "err", F.floor(c("n") / 2), "median_err").drop("n")
    return (out.join(middle, by, "left").withColumn("coverage_pct", c("matched") * 100 / c("rooms"))
            .withColumn("mae", F.coalesce("mae", F.lit(0.0))))


def best_by_label(measurements: DataFrame) -> DataFrame:
    """The most confident measurement per label."""
    rest = [n for n in measurements.columns if n not in ("plan_id", "label")]
    return (measurements.groupBy("plan_id", "label")
            .agg(F.max_by(F.struct(*rest), F.struct("confidence", -c("ord"))).alias("b"))
            .select("plan_id", "label", "b.*"))


def basis_counts(measurements: DataFrame, basis: str) -> DataFrame:
    return measurements.groupBy("plan_id", basis).agg(F.count(F.lit(1)).alias("n"))
