import math

import pytest
from pyspark.sql import functions as F

from asterfold.functions import morphology, sky, text, vectors
from asterfold.operators import audits, cells, population, retrieval, stats


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_pixels_nest_and_share_the_sphere_evenly(spark):
    n = 12_000
    z = (2 * F.col("id") + 1) / n - 1  # a spiral of places that are even over the sphere
    places = spark.range(n).select((F.col("id") * 137.50776405 % 360).alias("ra"), F.degrees(F.asin(z)).alias("dec"))
    got = places.select(*[sky.nested_pixel(F.col("ra"), F.col("dec"), k).alias(f"p{k}") for k in (0, 1, 5, 29)])
    assert got.where("shiftright(p29, 48) <> p5 or shiftright(p5, 8) <> p1 or shiftright(p1, 2) <> p0 or p0 not between 0 and 11").count() == 0
    counts = [r.n for r in got.groupBy("p1").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 48 and max(counts) < 280 and min(counts) > 220


def test_face_centres(spark):
    centre = math.degrees(math.asin(2 / 3))
    known = [(45.0, centre + 0.01, 0), (135.0, centre - 0.01, 1), (0.0, 0.0, 4), (359.9, 0.0, 4), (90.0, 0.0, 5), (315.0, -centre, 11), (10.0, 90.0, 0), (280.0, -90.0, 11)]
    got = spark.createDataFrame(known, "ra double, dec double, face int").where(sky.nested_pixel(F.col("ra"), F.col("dec"), 0) != F.col("face"))
    assert got.count() == 0


def test_leaves_finest_first_and_outside(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 0.0)], "id long, ra double, dec double")
    fine = points.where("id = 1").select(F.lit(4).alias("cell_order"), sky.nested_pixel(F.col("ra"), F.col("dec"), 4).alias("cell_pixel"))
    leaves = spark.createDataFrame([(0, 4), (0, 5)], "cell_order int, cell_pixel long").unionByName(fine)
    assert [(r.id, r.cell_order) for r in cells.assign_leaves(points, leaves, "ra", "dec").orderBy("id").collect()] == [(1, 4), (2, 0)]
    with pytest.raises(ValueError, match="outside"):
        cells.assign_leaves(points, leaves.where("cell_pixel = 4"), "ra", "dec")


def test_judge_path_and_answers(spark):
    said = '{"overall_shape":"featured-or-disk","edge_on":"edge-on-no","has_spiral_arms":"has-spiral-arms-yes","spiral_winding":"tight","spiral_arm_count":"2","bar":"strong","bulge_size":"small","merging":"none"}'
    silent = '{"overall_shape":"smooth","roundness":"not-mentioned","edge_on":"edge-on-yes"}'
    df = spark.createDataFrame([(1, said), (2, silent), (3, '{"overall_shape":"blob"}'), (4, "[]"), (5, "none"), (6, None)], "id long, r string")
    got = {r.id: r for r in df.select("id", morphology.fault(F.col("r")).alias("f"), morphology.path(morphology.parsed(F.col("r"))).alias("p"), morphology.answers(morphology.parsed(F.col("r"))).alias("a")).collect()}
    assert [got[k].f for k in range(1, 7)] == [None, None, "overall_shape", "no_json", "no_json", "no_json"]
    assert got[1].p == ["smooth-or-featured_featured-or-disk", "disk-edge-on_no", "has-spiral-arms_yes", "spiral-winding_tight", "spiral-arm-count_2", "bar_strong", "bulge-size_small", "merging_none"]
    assert got[2].p == ["smooth-or-featured_smooth", "how-rounded-not-mentioned"]
    assert got[2].a["how-rounded"] == got[2].a["merging"] == "not-stated" and got[2].a["disk-edge-on"] == "not-applicable"


def test_continuum(spark):
    df = spark.createDataFrame([([1.0, 1.0, 4.0, 1.0, 1.0],), ([-1.0, -1.0, -1.0],), ([1.0, 1.0, 0.0],)], "f array<double>")
    got = [r[0] for r in df.select(vectors.continuum_log(F.col("f"), 3)).collect()]
    assert got[0] == pytest.approx([0, 0, math.log(4), 0, 0]) and got[1] == [0, 0, 0] and got[2][:2] == [0, 0]
    with pytest.raises(ValueError, match="odd"):
        vectors.continuum_log(F.col("f"), 4)


def test_trailing_tokens(spark):
    df = spark.createDataFrame([("a <eos>\n<eos> ",), ("a  ",), ("<eos> a",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.without_trailing(F.col("t"), ["<eos>"])).collect()] == ["a", "a", "<eos> a", "", None]


def test_paired_sides(spark):
    answer = "id string, question string, gold string, correct boolean"
    a = spark.createDataFrame([("a", "q", "x", True), ("a", "r", "x", True), ("b", "q", "x", False)], answer)
    b = spark.createDataFrame([("a", "q", "x", False), ("a", "r", "x", True), ("b", "q", "x", False)], answer)
    assert round(audits.paired_delta(a, b, "id", 20, 1).first().estimate, 6) == round(1 / 3, 6)
    for other in (b.where("id = 'a'"), b.withColumn("gold", F.lit("y"))):
        with pytest.raises(ValueError):
            audits.paired_delta(a, other, "id", 20, 1)


def test_paired_errors_average_each_object_first(spark):
    base = [("a", s, c, 0.0, e) for s in (1, 2) for c, e in (("image", 1.0), ("fusion", 0.0))] + [("b", 1, "image", 0.0, 0.0), ("b", 1, "fusion", 0.0, 1.0), ("c", 1, "image", 0.0, 9.0)]
    got = stats.paired_errors(spark.createDataFrame(base, "o string, s int, c string, t double, p double"), "o", "s", "c", "image", "fusion", "p", "t", 50, 3)
    assert [(r.estimate, r.objects, r.decision) for r in got.where("scale = 'absolute'").collect()] == [(0.0, 2, "undecided")]


def test_pooled_seeds_count_once(spark):
    kind = "m string, seed int, v double"
    old, new = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0)], kind), spark.createDataFrame([("x", 2, 50.0), ("x", 3, 3.0)], kind)
    assert tuple(stats.pooled(old, new, ["m"], "seed", "v").first())[:3] == ("x", 3, 2.0)


def test_caps_and_grids(spark):
    df = spark.createDataFrame([("u", 1, 2.0), ("u", 2, 2.0), ("u", 3, 2.0), ("w", 1, 1.0)], "k string, n int, v double")
    assert rows(stats.passes_cap(df, ["k"], "n", "v", 3.0)) == [("u", 2, 4.0)]
    assert rows(stats.at_cap(df, ["k"], 3)) == [("u", 3)]
    assert rows(stats.grid_counts(df, {"k": ["u", "z"], "n": [1, 2]}, "rows")) == [("u", 1, 1), ("u", 2, 1), ("z", 1, 0), ("z", 2, 0)]


def test_guards(spark):
    e = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "k long, v array<double>")
    with pytest.raises(ValueError, match="no vector"):
        retrieval.assembled(spark.range(4).select(F.col("id").alias("k")), e.where("k = 1"), e.where("k = 2"), "k", "v")
    with pytest.raises(ValueError, match="both sides"):
        retrieval.assembled(e.select("k"), e, e, "k", "v")
    raw = spark.createDataFrame([(1, "s", 360.0, 0.0), (2, "s", 0.0, -90.0)], "k long, s string, ra double, dec double")
    columns = {"object_id": F.col("k"), "survey": F.col("s"), "ra": F.col("ra"), "dec": F.col("dec"), "source_row_id": F.col("k")}
    with pytest.raises(ValueError, match="ra"):
        population.normalize_source(raw, columns)
    assert population.normalize_source(raw.where("k = 2"), columns).first().object_id == "2"
