"""Spatial joins where a radius holds many rows: no broadcast, no product of the sides, no cap."""

import math
import random

from pyspark.sql import functions as F

from asterfold.operators import prechecks, sphere

ON = ("ra", "dec", "r2", "d2")


def patch(seed, n):
    rng = random.Random(seed)
    rows = [(i, round(rng.uniform(0, 20), 3), round(rng.uniform(80, 90), 3)) for i in range(n)]
    return [(i, 5.0, 85.0) if i % 50 == 0 else (i, a, 90.0) if i % 50 == 1 else (i, a, d) for i, a, d in rows]  # shared places, and the pole


def arcsec(a, b):
    u, v = ((math.cos(math.radians(d)) * math.cos(math.radians(r)), math.cos(math.radians(d)) * math.sin(math.radians(r)), math.sin(math.radians(d))) for r, d in (a, b))
    return round(math.degrees(2 * math.asin(min(1.0, math.dist(u, v) / 2))) * 3600, 6)


def sides(spark, n, m):
    left, right = [*patch(1, n), (-1, 200.0, -50.0)], patch(2, m)
    return left, right, spark.createDataFrame(left, "i long, ra double, dec double"), spark.createDataFrame(right, "j long, r2 double, d2 double")


def test_dense_searches_meet_the_nearest_rows(spark):
    left, right, a, b = sides(spark, 200, 1500)
    for k in (1, 3):
        assert len(sphere.reaches(b, 7200.0, ON, k)) > 1
        got = {(r.i, r.candidate_rank): (r.j, r.separation_arcsec) for r in sphere.nearest(a, b, 7200.0, ON, "i", "j", k, "left").collect()}
        want = {}
        for i, *p in left:
            near = sorted((s, j) for j, *q in right if (s := arcsec(p, q)) <= 7200)[:k]
            want |= {(i, n + 1): (j, s) for n, (s, j) in enumerate(near)} or {(i, 1): (None, None)}
        assert got.keys() == want.keys()
        assert all(got[x][0] == want[x][0] and (want[x][1] is None or abs(got[x][1] - want[x][1]) < 1e-5) for x in want)


def test_pairs_are_neither_broadcast_nor_sorted(spark):
    *_, a, b = sides(spark, 20, 30)
    plan = sphere.pairs_within(a, b, 7200.0, ON)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_a_self_match_meets_each_row_at_the_pole(spark):
    df = spark.createDataFrame([(i, 7.0 * i, -90.0) for i in range(20)] + [(30, 10.0, 20.0), (31, 10.0, 20.0)], "i long, ra double, dec double")
    assert {tuple(r) for r in sphere.self_match(df, "ra", "dec", "i", own_first=True).collect()} == {(i, i, 0.0) for i in [*range(20), 30, 31]}


def test_untruncated_lists_have_no_limit_of_their_own(spark, tmp_path):
    from asterfold.plans import readouts

    place = "id * 1800"  # every one at the pole
    spark.range(2).selectExpr(f"{place} as c_custkey", "'m' as c_mktsegment", "1 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(250).selectExpr(f"{place} as s_suppkey", "1 as s_nationkey", "1.0D as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    got = readouts.sphere_untruncated(spark, str(tmp_path)).collect()
    assert {(r.c_custkey, r.candidate_rank) for r in got} == {(c, n) for c in (0, 1800) for n in range(1, 251)}


def rows_out(plan):
    """Rows that a run plan, or what lies below it, put out."""
    metric = "shuffleRecordsWritten" if plan.nodeName() == "Exchange" else "numOutputRows"
    if plan.metrics().contains(metric):
        return plan.metrics().apply(metric).value()
    return sum(rows_out(plan.children().apply(n)) for n in range(plan.children().size()))


def rows_sorted(plan):
    own = rows_out(plan) if plan.nodeName() == "Sort" else 0
    return own + sum(rows_sorted(plan.children().apply(n)) for n in range(plan.children().size()))


def test_the_nearest_of_many_copies_sorts_no_pairs(spark):
    a = spark.range(400).selectExpr("id as i", "10.0 + id / 1000 as ra", "20.0D as dec", "concat('n', id) as note")
    b = spark.range(3000).selectExpr("3000 - id as j", "10.0 + (id % 3) / 5 as r2", "20.0D as d2", "id % 7 as mark")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sphere.nearest(a, b, 7200.0, ON, "i", "j")
        rows = {r.i: (r.j, r.note, r.mark) for r in got.collect()}
        assert rows_sorted(got._jdf.queryExecution().executedPlan()) <= 2 * 400  # pairs: 400 with 1000 copies each
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = {i: min((arcsec((10 + i / 1000, 20.0), (10 + c / 5, 20.0)), {0: 3, 1: 2, 2: 1}[c]) for c in range(3))[1] for i in range(400)}
    assert rows == {i: (j, f"n{i}", (3000 - j) % 7) for i, j in want.items()}


def test_missing_ids_and_places_keep_their_rows(spark):
    a = spark.createDataFrame([(1, 10.0, 20.0), (None, 10.0, 20.0), (3, None, 20.0), (4, 50.0, 20.0)], "i long, ra double, dec double")
    b = spark.createDataFrame([("b", 10.0, 20.0), ("a", 10.0, 20.0), ("c", None, None), (None, 50.0, 20.0), ("d", 50.0, 20.0)], "j string, r2 double, d2 double")
    got = sphere.nearest(a, b, 60.0, ON, "i", "j", 1, "left").collect()
    assert {(r.i, r.j, r.separation_arcsec) for r in got} == {(1, "a", 0.0), (None, "a", 0.0), (3, None, None), (4, None, 0.0)}
    assert {(r.i, r.j) for r in sphere.nearest(a, b, 60.0, ON, "i", "j").collect()} == {(1, "a"), (None, "a"), (4, None)}


def test_a_crosstab_over_many_copies_sorts_no_pairs(spark, monkeypatch):
    sorted_rows = []

    def run(df, name):
        rows = df.collect()
        sorted_rows.append(rows_sorted(df._jdf.queryExecution().executedPlan()))
        return spark.createDataFrame(rows, df.schema)

    a = spark.range(300).selectExpr("id as i", "10.0 + id / 1000 as ra", "20.0D as dec", "id / 300 as z")
    b = spark.range(2000).selectExpr("2000 - id as j", "10.0 + (id % 2) / 5 as r2", "20.0D as d2")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    monkeypatch.setattr(prechecks, "staged", run)
    try:
        got = prechecks.coverage_audit(a, b, 7200.0, ON, "i", "j", "z", {"odd": F.col("j") % 2 == 1}, [0.0, 0.25, 0.5], shared=True)
        cells = {r.low: (r.total_objects, r.matched_objects, r.positive_objects) for r in got.crosstab.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    odd = [arcsec((10 + i / 1000, 20.0), (10.2, 20.0)) <= arcsec((10 + i / 1000, 20.0), (10.0, 20.0)) for i in range(300)]  # there is id 1, at the other place 2
    assert cells == {0.0: (75, 75, sum(odd[:75])), 0.25: (75, 75, sum(odd[75:150]))} and 0 < sum(odd[75:150])
    assert sorted_rows and max(sorted_rows) <= 2 * 300  # pairs: 300 with 1000 copies each


def pairs_made(plan):
    """Most rows that a join of a run plan put out."""
    own = rows_out(plan) if "Join" in plan.nodeName() else 0
    return max([own, *(pairs_made(plan.children().apply(n)) for n in range(plan.children().size()))])


def test_copies_of_a_place_make_no_pairs(spark, monkeypatch):
    made = []

    def run(df, name):
        rows = df.collect()
        made.append(pairs_made(df._jdf.queryExecution().executedPlan()))
        return spark.createDataFrame(rows, df.schema)

    a = spark.range(600).selectExpr("id as i", "10.0 + (id % 3) / 1000 as ra", "20.0D as dec", "(id % 100) / 100 as z")
    b = spark.range(1000).selectExpr("1000 - id as j", "10.0 + (id % 2) / 5 as r2", "20.0D as d2", "id % 7 as mark")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    monkeypatch.setattr(sphere, "staged", run)
    try:
        near = sphere.nearest(a, b, 7200.0, ON, "i", "j")
        rows = {r.i: (r.j, r.mark) for r in near.collect()}
        made.append(pairs_made(near._jdf.queryExecution().executedPlan()))
        cells = prechecks.coverage_audit(a, b, 7200.0, ON, "i", "j", "z", {"odd": F.col("j") % 2 == 1}, [0.0, 0.25, 0.5], shared=True).crosstab.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert rows == {i: (2, 998 % 7) for i in range(600)}  # the smallest id of the nearer place
    assert {(r.low, r.total_objects, r.matched_objects, r.positive_objects) for r in cells} == {(0.0, 150, 150, 0), (0.25, 150, 150, 0)}
    assert 600 <= max(made) <= 1000  # rows; pairs of rows: 300,000 at either place


def test_separations_alike_when_rounded_are_ties(spark):
    arc = 1 / 3600
    a = spark.createDataFrame([(1, 10.0, 0.0), (2, 10.0, 0.0)], "i long, ra double, dec double")
    for far in (1.0, 3000.0):
        b = spark.createDataFrame([(5, 10.0, (far + 1e-7) * arc), (3, 10.0, (far + 3e-7) * arc), (1, 10.0, (far + 9e-7) * arc)], "j long, r2 double, d2 double")
        assert {(r.i, r.j, r.separation_arcsec) for r in sphere.nearest(a, b, 7200.0, ON, "i", "j").collect()} == {(1, 3, far), (2, 3, far)}
