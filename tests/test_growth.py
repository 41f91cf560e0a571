"""Counts within intervals without pairs, and draws without conversions."""

import random

from pyspark.sql import functions as F

from asterfold.functions import hashing
from asterfold.operators import bins, stats


def test_sizes_count_values_below_ends(spark):
    rng = random.Random(5)
    values = [round(rng.uniform(0, 20), 1) for _ in range(500)] + [None, float("nan"), 3.0, 3.0]
    edges = [(i, lo, lo + 1.0) for i, lo in enumerate(round(rng.uniform(-2, 22), 1) for _ in range(40))] + [(90, None, 3.0), (91, 3.0, None), (92, None, None), (93, 5.0, 4.0)]
    rows, table = spark.createDataFrame([(v,) for v in values], "v double"), spark.createDataFrame(edges, "i int, lo double, hi double")
    got = {r.i: r.n for r in bins.sizes(rows, "v", table, "lo", "hi", "n").collect()}
    real = [v for v in values if v is not None and v == v]
    assert got == {i: sum((lo is None or v >= lo) and (hi is None or v < hi) for v in real) for i, lo, hi in edges}


def test_draws_are_those_of_the_fraction(spark):
    u = hashing.fraction(F.col("id"), F.col("resample").cast("string"), "bootstrap-3")
    rows = stats.poisson_draws(spark.range(300), "id", 20, 3).select("c", u.alias("u")).collect()
    ends, mass = [0.36787944117144233], 0.36787944117144233
    for k in range(1, 8):
        mass /= k
        ends.append(ends[-1] + mass)
    assert len(rows) == 6000 and all(r.c == sum(r.u >= e for e in ends) for r in rows)
    assert all(float(stats.reaching(e)) / 2.0**64 >= e > float(stats.reaching(e) - 1) / 2.0**64 for e in ends)
