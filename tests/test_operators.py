import math

import pytest
from pyspark.sql import functions as F

from asterfold.functions import hashing, scores, text, vectors
from asterfold.operators import audits, population, probes, retrieval, sphere, stats, validation
from asterfold.sources import tables
from asterfold.streaming import generate


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ndcg_by_hand(spark):
    graded = spark.createDataFrame([(1, k, float(r), 4.0 - k) for k, r in enumerate([1, 0.7, 0.2, 0])], "q long, c long, rel double, score double")
    assert retrieval.ndcg(graded, ["q"], "c", "rel", 4).first().ndcg_at_4 == 1.0
    none = graded.withColumn("rel", F.lit(0.0))
    assert retrieval.ndcg(none, ["q"], "c", "rel", 4).first().ndcg_at_4 == 0.0
    assert spark.range(1).select(retrieval.gain(F.lit(2.0), F.lit(1))).first()[0] == 3.0


def test_recall_and_ties(spark):
    df = spark.createDataFrame([(0, 0, 1.0, True), (0, 1, 0.0, False), (1, 0, 1.0, False), (1, 1, 1.0, True)], "q long, c long, score double, hit boolean")
    assert rows(retrieval.recall(df, ["q"], "c", "hit", [1, 2])) == [(1, 0.5), (2, 1.0)]


def test_missing_votes_pass_nothing(spark):
    df = spark.createDataFrame([(0.9, float("nan")), (0.9, 0.9), (None, 0.9), (0.5, 0.99)], "a double, b double")
    assert [r[0] for r in df.select(scores.path_flag(F.col("a"), F.col("b"), threshold=0.7)).collect()] == [False, True, False, False]
    assert [r[0] for r in df.select(scores.path_strength(F.col("a"), F.col("b"))).collect()] == [0.0, 0.9, 0.0, 0.5]


def test_interval_score(spark):
    z = spark.createDataFrame([(0.10,), (0.20,), (0.25,)], "z double").select(scores.interval_score(F.col("z"), 0.10, 0.20))
    assert [round(r[0], 9) for r in z.collect()] == [1.0, 1.0, round(math.exp(-1), 9)]


def test_reasons(spark):
    df = spark.createDataFrame([(4, 0.0, 0.1), (0, float("nan"), 0.0), (0, 1.0, 0.1)], "w int, z double, e double")
    got = [r[0] for r in df.select(scores.spectrum_reasons(F.col("w"), F.col("z"), F.col("e"), 0.001)).collect()]
    assert got == ["zwarn_not_zero;redshift_below_minimum", "redshift_nonfinite;redshift_error_not_positive", ""]


def test_sphere_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    a = [(i, rng.choice([0.0, 359.9999, 10.0]) + rng.uniform(-1e-3, 1e-3), rng.choice([89.9995, 0.0, -45.0]) + rng.uniform(-4e-4, 4e-4)) for i in range(200)]
    b = [(i, rng.choice([0.0, 359.9999, 10.0]) + rng.uniform(-1e-3, 1e-3), rng.choice([89.9995, 0.0, -45.0]) + rng.uniform(-4e-4, 4e-4)) for i in range(150)]

    def xyz(ra, dec):
        ra, dec = math.radians(ra), math.radians(dec)
        return math.cos(dec) * math.cos(ra), math.cos(dec) * math.sin(ra), math.sin(dec)

    want = {(i, j) for i, *p in a for j, *q in b if math.dist(xyz(*p), xyz(*q)) <= 2 * math.sin(math.radians(3 / 3600) / 2)}
    left, right = spark.createDataFrame(a, "i long, ra double, dec double"), spark.createDataFrame(b, "j long, ra2 double, dec2 double")
    got = [(r.i, r.j) for r in sphere.pairs_within(left, right, 3.0, ("ra", "dec", "ra2", "dec2")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_nearest_tie_takes_smaller_id(spark):
    left = spark.createDataFrame([("a", 10.0, 0.0)], "i string, ra double, dec double")
    right = spark.createDataFrame([("200", 10.0001, 0.0), ("100", 9.9999, 0.0)], "j string, ra2 double, dec2 double")
    assert sphere.nearest(left, right, 1.0, ("ra", "dec", "ra2", "dec2"), "i", "j").first().j == "100"
    absent = sphere.absent_separations(right.withColumnsRenamed({"ra2": "x", "dec2": "y"}), left, ("x", "y", "ra", "dec"), "j", "i")
    assert {r.j: round(r.separation_arcsec, 2) for r in absent.collect()} == {"100": 0.36, "200": 0.36}


def test_population(spark):
    source = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "object_id string")
    got = population.fill_population(source, source.where("object_id = 'a'"), spark.createDataFrame([("d", 0), ("c", 1)], "object_id string, priority_rank int"), 2, "s", 1)
    assert {r.object_id for r in got.collect()} == {"a", "d"} and {r.selection_rank for r in got.collect()} == {0, 1}
    left = population.common_ids(source, source.where("object_id > 'b'"))
    assert rows(left) == [("c",), ("d",)]


def test_split_is_a_hash(spark):
    import hashlib

    got = spark.createDataFrame([("x",)], "k string").select(hashing.fraction(F.col("k"), "5")).first()[0]
    assert got == int(hashlib.sha256(b"x|5").hexdigest()[:16], 16) / 2**64
    d = hashing.derangement(spark.range(5).select("id", F.lit(1).alias("g")), "id", 2, ["g"]).collect()
    assert all(r.id != r.partner for r in d) and {r.partner for r in d} == set(range(5))


def test_statistics_by_hand(spark):
    r = spark.createDataFrame([(x,) for x in (-0.02, -0.01, 0.0, 0.01, 0.05)], "x double").withColumn("g", F.lit(1))
    assert stats.nmad(r, ["g"], "x").first().nmad == round(1.4826 * 0.01, 6)
    p = spark.createDataFrame([(0.0, 0.0), (0.2, 0.0), (1.0, 1.0), (1.5, 1.0)], "p double, t double").withColumn("g", F.lit(1))
    assert stats.regression(p, ["g"], "p", "t", 0.15).first().outlier_fraction == 0.5
    edge = spark.createDataFrame([(0.15, 0.0)], "p double, t double").withColumn("g", F.lit(1))
    assert stats.regression(edge, ["g"], "p", "t", 0.15).first().outlier_fraction == 0.0
    m = spark.createDataFrame([(1.5, 1.0), (2.0, 2.0), (2.0, 3.0)], "p double, t double").withColumn("g", F.lit(1))
    assert stats.regression(m, ["g"], "p", "t", 0.15).first().mae == 0.5


def test_trees_and_audits(spark):
    human = spark.createDataFrame([(1, '[{"question":"a","answer":"x"},{"node":"n"},{"question":"b","answer":"y"}]')], "k long, h string")
    judge = spark.createDataFrame([(1, '[{"node":"n"},{"question":"a","answer":"x"}]')], "k long, j string")
    r = audits.path_rows(human, judge, "k", "h", "j").first()
    assert (r.matched_nodes, r.human_nodes, r.score) == (2, 3, round(2 / 3, 6))
    twice = spark.createDataFrame([('[{"question":"a","answer":"x"},{"question":"a","answer":"z"}]',)], "h string")
    assert twice.select(text.tree_answers(F.col("h"))).first()[0] == {"a": "z"}


def test_checks_raise(spark):
    df = spark.createDataFrame([(1,), (1,)], "k long")
    with pytest.raises(ValueError, match="duplicate"):
        validation.require_unique(df, "k")
    with pytest.raises(ValueError, match="missing columns: z"):
        validation.require_columns(df, ["z"])
    a, b = spark.range(10).withColumn("x", F.col("id") * 2), spark.range(9, -1, -1).withColumn("x", F.col("id") * 2)
    assert validation.fingerprint(a).first() == validation.fingerprint(b).first() != validation.fingerprint(a.withColumn("x", F.col("x") + 1)).first()


def test_ridge_is_the_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=80) * 0.01
    df = spark.createDataFrame([(k, k % 4, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "id long, fold int, v array<double>, y double")
    got = {r.id: r.prediction for r in probes.ridge_probe(df, df, "v", "y", "fold", [1.0]).collect()}
    s = (x - x.mean(0)) / x.std(0)
    want = s @ np.linalg.solve(s.T @ s + np.eye(3), s.T @ (y - y.mean())) + y.mean()
    assert max(abs(got[k] - want[k]) for k in range(80)) < 1e-9


def test_generation_resumes_and_stops(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "")], "object_id string, text string")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    for _ in range(2):
        assert generate.append_results(spark, df, "object_id", "text", lambda t: t, good, bad, 0.5) == {"completed": 1, "errors": 1, "pending": 0}
    with pytest.raises(RuntimeError):
        generate.append_results(spark, df, "object_id", "text", lambda t: t, good, bad, 0.1)


def test_vectors_and_tables(spark, tmp_path):
    v = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    assert list(v.select(vectors.normalized(F.col("a"))).first()[0]) == pytest.approx([0.6, 0.8]) and v.select(vectors.normalized(F.col("z"))).first()[0] is None
    out = v.select(vectors.resampled(F.array(F.lit(0.0), F.lit(10.0)), F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(-1.0), F.lit(0.5), F.lit(2.0)))).first()[0]
    assert out == [0.0, 5.0, 10.0]
    path = str(tmp_path / "m.parquet")
    tables.write_manifest(spark.range(5), path)
    assert tables.verified(spark, path).count() == 5
    assert tables.cell_path(5, 12345) == "Norder=5/Dir=10000/Npix=12345"
