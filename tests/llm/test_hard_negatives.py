"""Strassen products, heaps and hard negatives against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.common import import_path
from plumbline.llm.hard_negatives import Heaps, hard_negative_table, hard_negatives, strassen, whole_numbers

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for n, d, m in ((1, 1, 1), (33, 64, 47), (70, 35, 129), (5, 200, 64), (64, 64, 64), (1, 64, 300), (40, 0, 3)):
        a, b = rng.integers(-300, 300, (n, d)), rng.integers(-300, 300, (d, m))
        assert (strassen(a, b, leaf=4) == a @ b).all() and (strassen(a, b) == a @ b).all()
    a, b = rng.integers(-2**62, 2**62, (20, 36)), rng.integers(-2**62, 2**62, (36, 50))
    exact = (a.astype(object) @ b.astype(object) + 2**63) % 2**64 - 2**63   # the same number modulo 2^64
    assert (strassen(a, b, leaf=3).astype(object) == exact).all()


def test_heaps_merge_in_any_blocks():
    rng = np.random.default_rng(2)
    for k in (1, 3, 10):
        scores, allowed = rng.integers(-4, 4, (17, 90)), rng.random((17, 90)) < .6
        allowed[0] = False
        heaps = Heaps(17, k)
        cuts = [0, *sorted(rng.choice(np.arange(1, 90), 7, replace=False)), 90]
        for a, b in zip(cuts, cuts[1:]):
            heaps.merge(scores[:, a:b], allowed[:, a:b], a)
        for i in range(17):
            want = sorted((j for j in range(90) if allowed[i, j]), key=lambda j: (-scores[i, j], j))[:k]
            assert heaps.place[i].tolist() == want + [-1] * (k - len(want))


def plain(rows, n_positive=5, n_negative=10):
    rows = [(i, v, lab) for i, v, lab in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v],
             (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab in rows]
    out = []
    for a, (i, v, lab) in enumerate(rows):
        if i is None or i % 100:
            continue
        score = [sum(x * y for x, y in zip(v, w)) for _, w, _ in rows]
        order = sorted(range(len(rows)), key=lambda c: (-score[c], rows[c][0] is None, rows[c][0] or 0, c))
        for p in [c for c in order if c != a and rows[c][2] == lab][:n_positive]:
            near = [c for c in order if rows[c][2] != lab and 30 * score[p] <= 100 * score[c] <= 90 * score[p]]
            out += [(i, rows[p][0], n, rows[c][0], score[p], score[c]) for n, c in enumerate(near[:n_negative], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def fixture():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(.08, .1, 8))], int(rng.integers(0, 3))) for i in range(700)]
    rows += [(900 + i, rows[5][1], i % 2) for i in range(40)]                    # ties in every heap
    rows += [rows[100], rows[100], (100, rows[3][1], 2)]                           # anchors that repeat
    rows += [(None, rows[7][1], 1), (800, None, 1), (1000, rows[8][1], None), (1100, [None] * 8, 1),
             (1200, [math.nan] + [0.0] * 7, 1), (1300, [math.inf] + [0.0] * 7, 1), (1400, [], 2), (1500, [.5, .25], 1),
             (-100, rows[9][1], 0), (-7, rows[9][1], 9), (1600, rows[1][1], 77)]
    return rows


def test_against_plain_loops(spark, fixture):
    import_path(spark)
    df = spark.createDataFrame(fixture, SCHEMA).repartition(5, "vec_id")
    got = sorted((tuple(r) for r in hard_negative_table(df).collect()), key=repr)
    assert got == plain(fixture)
    clash = df.select("*", *[F.lit(1).alias(x) for x in ("uid", "id", "v", "tile", "stripe", "x", "score")])
    assert sorted((tuple(r) for r in hard_negative_table(clash).collect()), key=repr) == got


def test_tiles_and_stripes_do_not_matter(spark, fixture):
    rows = whole_numbers(spark.createDataFrame(fixture[:300], SCHEMA))
    asked = F.col("id") % 20 == 0
    want = None
    for tile, stripe, least in ((4, 50, 1), (1000, 1 << 20, 1), (7, 1 << 20, 9)):
        found = hard_negatives(rows, asked, positives=3, negatives=4, tile=tile, stripe=stripe, least_stripes=least)
        got = sorted(tuple(r)[:6] for r in found.collect())
        assert got and (want is None or got == want)
        want = got


def test_empty(spark):
    assert hard_negative_table(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negative_table(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)).count() == 0
