"""Exact positions in groups of any size."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import plantext


def sets(rnd):
    out = {"one": [3.5], "equal": [2.0] * 40, "few": [rnd.random() for _ in range(7)], "wide": [10.0 ** rnd.randint(-300, 300) for _ in range(400)],
           "signed": [rnd.choice([-1, 1]) * rnd.random() * 1e308 for _ in range(300)], "dense": [1 + rnd.randint(0, 900) * 2.0**-52 for _ in range(900)],
           "mixed": [rnd.gauss(0, 1) for _ in range(1500)] + [0.25] * 700}
    return out


@pytest.mark.parametrize("limit", [5, 300])
def test_positions(spark, limit):
    found = sets(random.Random(1))
    df = spark.createDataFrame([(k, v) for k, vs in found.items() for v in vs], "g string, v double").repartition(4)
    for part in (0.3, 0.999):
        got = {r.g: (r.at, r.n) for r in plantext.value_at(df, ["g"], "v", F.floor(F.col("n") * part), "at", limit=limit).collect()}
        assert got == {k: (sorted(vs)[int(len(vs) * part)], len(vs)) for k, vs in found.items()}


def test_all_values_in_one_group(spark):
    """A hot group is narrowed: no task orders more than the limit."""
    n = 300_000
    df = spark.range(n).select(F.lit("hot").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7.0).alias("v"))
    values = sorted(r.v for r in df.select("v").collect())
    got = plantext.value_at(df, ["g"], "v", F.floor(F.col("n") / 2), "at", limit=1000).first()
    assert (got.at, got.n) == (values[n // 2], n)


def test_empty(spark):
    assert plantext.value_at(spark.createDataFrame([], "g string, v double"), ["g"], "v", F.lit(0), "at").count() == 0
