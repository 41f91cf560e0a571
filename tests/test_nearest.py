"""The nearest place at any distance, and graded metrics from mergeable top lists, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asterfold.operators import nearest, sphere, toplists


def unit(rows):
    ra, dec = np.radians([r[1] for r in rows]), np.radians([r[2] for r in rows])
    return np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], axis=1)


def brute(left, right):
    a, b, ids = unit(left), unit(right), [r[0] for r in right]
    out = {}
    for (i, *_), p in zip(left, a, strict=True):
        d = np.degrees(2 * np.arcsin(np.minimum(np.sqrt(((b - p) ** 2).sum(axis=1)) / 2, 1))) * 3600
        at = min(range(len(ids)), key=lambda k: (round(d[k], 6), ids[k]))
        out[i] = (ids[at], d[at])
    return out


def places(seed, n, kind):
    rng = random.Random(seed)
    if kind == "sphere":
        return [(k, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for k in range(n)]
    if kind == "poles":
        return [(k, rng.uniform(0, 360), rng.choice([-1, 1]) * (90 - rng.expovariate(3))) for k in range(n)]
    if kind == "cluster":  # most in a spot of a few arc seconds, a few far off
        return [(k, 10 + rng.gauss(0, 1e-3), 20 + rng.gauss(0, 1e-3)) if k % 50 else (k, rng.uniform(0, 360), rng.uniform(-90, 90)) for k in range(n)]
    return [(k, 0.0, 0.0) if k % 3 else (k, 180.0, 0.0) for k in range(n)]  # two places, many times over


@pytest.mark.parametrize("kind", ["sphere", "poles", "cluster", "same"])
def test_nearest_at_any_distance(spark, kind):
    left = [*places(1, 120, "sphere"), (900, 0.0, 90.0), (901, 12.0, -90.0), (902, 359.9999, 0.0), (903, 190.0, -20.0)]
    right = places(2, 1500, kind)
    a = spark.createDataFrame([*left, (990, None, 1.0)], "i long, ra double, dec double")
    b = spark.createDataFrame([*right, (7000, 1.0, None)], "j long, x double, y double")
    got = {r.i: (r.j, r.separation_arcsec) for r in nearest.nearest_anywhere(a, b, ("ra", "dec", "x", "y"), "i", "j").collect()}
    want = brute(left, right)
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-5 for i in want)


def test_a_hierarchy_goes_down_where_places_crowd(spark):
    rows = places(3, 3000, "cluster")
    tree = nearest.hierarchy(spark.createDataFrame(rows, "j long, x double, y double"), "x", "y", "j")
    even = nearest.hierarchy(spark.createDataFrame(places(3, 3000, "sphere"), "j long, x double, y double"), "x", "y", "j")
    assert tree.level > even.level and tree.cells.agg(F.sum("n")).first()[0] == 3000


def test_full_coverage_names_matches_only(spark):
    left, right = places(5, 60, "sphere"), places(6, 60, "sphere")
    a, b = spark.createDataFrame(left, "i long, ra double, dec double"), spark.createDataFrame(right, "j long, x double, y double")
    want = brute(left, right)
    for r in sphere.full_coverage(a, b, 20_000.0, ("ra", "dec", "x", "y"), "i", "j").collect():
        near, d = want[r.i]
        assert (r.status, r.source_object_id) == (("matched", near) if d <= 20_000 else ("absent", None)) and abs(r.separation_arcsec - d) < 1e-5
    with pytest.raises(ValueError):
        sphere.full_coverage(a, b.limit(0), 1.0, ("ra", "dec", "x", "y"), "i", "j")


def metrics(rows, k):
    gain = lambda grades: sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(grades))
    best = sorted(rows, key=lambda r: (-r[2], r[1]))[:k]
    ideal = sorted((r[3] for r in rows), reverse=True)[:k]
    p, hits = sum(r[4] for r in rows), sum(r[4] for r in best)
    strengths = [r[5] for r in best if r[5] is not None]
    return (len(rows), p, hits / p if p else None, min(k, p) / p if p else None, hits / min(k, len(rows)), sum(strengths) / len(strengths) if strengths else None, gain([r[3] for r in best]) / gain(ideal) if gain(ideal) else 0.0)


def close(a, b):
    return a is b if a is None or b is None else abs(a - b) < 2e-6


def test_top_lists_are_those_of_whole_groups(spark):
    rng = random.Random(3)
    # one group holds most rows, scores are often alike, one group has no positive, one a null name
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None, "none"]), k, round(rng.random(), 1), 0.0, False, rng.choice([None, rng.random()])) for k in range(4000)]
    rows = [(*r[:3], 0.0, False, r[5]) if r[0] == "none" else (*r[:3], g := rng.choice([0.0, 0.0, 0.25, 0.5, 1.0]), g > 0.4, r[5]) for r in rows]
    df = spark.createDataFrame(rows, "g string, id long, score double, grade double, hit boolean, strength double").repartition(7)
    got = {r.g: tuple(r)[1:] for r in toplists.group_metrics(df, ["g"], "id", "grade", "hit", 10, {"mean": F.col("strength")}).collect()}
    assert got.keys() == {r[0] for r in rows}
    for g, values in got.items():
        assert all(close(x, y) for x, y in zip(values, metrics([r for r in rows if r[0] == g], 10), strict=True)), g
    whole = toplists.group_metrics(df, [], "id", "grade", "hit", 10).first()
    assert whole.n == len(rows) and close(whole.ndcg_at_10, metrics(rows, 10)[-1])
    assert toplists.group_metrics(df.limit(0), ["g"], "id", "grade", "hit", 10).count() == 0


def test_top_lists_need_no_window(spark):
    df = spark.range(100).selectExpr("id % 3 as g", "id", "rand(1) as score", "0.5D as grade", "true as hit")
    plan = toplists.group_metrics(df, ["g"], "id", "grade", "hit", 10)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1


def test_self_match_meets_each_row(spark):
    rows = [*places(7, 40, "sphere"), (900, 10.0, 20.0), (901, 10.0, 20.0)]
    df = spark.createDataFrame(rows, "i long, ra double, dec double")
    got = {r.i: (r.match, r.separation_arcsec) for r in sphere.self_match(df, "ra", "dec", "i").collect()}
    assert got == {i: (900 if i == 901 else i, 0.0) for i, *_ in rows}
    with pytest.raises(ValueError, match="not met"):
        sphere.self_match(df.union(spark.createDataFrame([(5000, None, 1.0)], df.schema)), "ra", "dec", "i")
    with pytest.raises(ValueError, match="duplicate"):
        sphere.self_match(df.union(df.limit(1)), "ra", "dec", "i")
