"""Guards that raise, exact order statistics, probes against closed forms, sources, sinks and the stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from asterfold.functions import text
from asterfold.operators import audits, caches, order, pairing, population, probes, retrieval, sphere, stats, validation
from asterfold.sources import tables
from asterfold.streaming import generate


def raises(match, run):
    with pytest.raises(Exception, match=match):
        run()


def test_audits_raise_where_a_side_is_missing(spark):
    tree = json.dumps([{"question": "size", "answer": "large"}, {"node": "end"}])
    human = spark.createDataFrame([(1, tree), (2, tree)], "id int, h string")
    judge = spark.createDataFrame([(1, tree)], "id int, j string")
    raises("no judge's tree", lambda: audits.path_rows(human, judge, "id", "h", "j").collect())
    raises("duplicate", lambda: audits.path_rows(human, judge.union(judge), "id", "h", "j").collect())
    assert [r.human_path for r in audits.path_rows(human.where("id = 1"), judge, "id", "h", "j").collect()] == [["size_large", "end"]]
    said = lambda df: df.select("id", text.tree_answers(df[1]).alias("a"))
    raises("no predicted answers", lambda: audits.answer_rows(said(human), said(judge).withColumnRenamed("a", "p"), "id", "a", "p").collect())
    for bad in ("[]", '[{"question": "q"}]'):
        raises("node", lambda: spark.createDataFrame([(bad,)], "t string").select(text.tree_path(F.col("t"))).collect())


def test_path_delta_needs_the_same_human_paths(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id int, human_path array<string>, score double")
    a, b = rows((1, ["x"], 0.0), (2, ["x"], 1.0)), rows((1, ["x"], 1.0), (2, ["x"], 1.0))
    assert audits.paired_path_delta(b, a, "id", 20, 1).first().estimate == 0.5
    raises("unlike human paths", lambda: audits.paired_path_delta(a, rows((1, ["y"], 1.0), (2, ["x"], 1.0)), "id", 20, 1))
    raises("one side only", lambda: audits.paired_path_delta(a, b.where("id = 1"), "id", 20, 1))


def test_population_guards(spark):
    source = spark.range(20).select(F.col("id").alias("object_id"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "object_id long")
    ranked = lambda *x: spark.createDataFrame([(i, k) for k, i in enumerate(x)], "object_id long, priority_rank int")
    fill = lambda a, p, n, out=None, s=source: population.fill_population(s, a, p, n, "salt", 1, excluded=out).collect()
    got = fill(ids(3), ranked(7, 5, 7), 3, ids(9))
    assert {(r.object_id, r.selection_reason) for r in got} == {(3, "anchor"), (7, "priority"), (5, "priority")} and sorted(r.selection_rank for r in got) == [0, 1, 2]
    raises("not in the source", lambda: fill(ids(99), ranked(), 3))
    raises("not in the source", lambda: fill(ids(), ranked(99), 3))
    raises("excluded", lambda: fill(ids(3), ranked(), 3, ids(3)))
    raises("2 anchors", lambda: fill(ids(1, 2), ranked(), 1))
    raises("eligible", lambda: fill(ids(), ranked(), 20, ids(0)))
    raises("duplicate", lambda: fill(ids(), ranked(), 3, None, source.union(ids(4))))
    raises("positive size", lambda: fill(ids(), ranked(), 0))
    raises("duplicate", lambda: population.exact_coverage(source, ids(1, 1), "x"))


def test_sphere_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    ra, dec = rng.uniform(0, 360, 300), np.degrees(np.arcsin(rng.uniform(-1, 1, 300)))
    ra[:40], dec[:40], ra[40:80] = rng.uniform(0, 360, 40), 89.9 + rng.uniform(0, 0.1, 40), rng.uniform(-0.02, 0.02, 40) % 360
    dec[40:80] = rng.uniform(-0.02, 0.02, 40)
    unit = np.stack([np.cos(np.radians(dec)) * np.cos(np.radians(ra)), np.cos(np.radians(dec)) * np.sin(np.radians(ra)), np.sin(np.radians(dec))], 1)
    apart = np.degrees(2 * np.arcsin(np.clip(np.linalg.norm(unit[:, None] - unit[None], axis=2) / 2, 0, 1))) * 3600
    a = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(ra, dec, strict=True))], "i int, ra double, dec double")
    b = a.select(F.col("i").alias("j"), F.col("ra").alias("r2"), F.col("dec").alias("d2"))
    for radius in (30.0, 4000.0):
        got = {(r.i, r.j) for r in sphere.pairs_within(a, b, radius, ("ra", "dec", "r2", "d2")).collect()}
        assert got == set(zip(*map(lambda x: x.tolist(), np.nonzero(apart <= radius)), strict=True))
    cover = {r.i: r for r in sphere.full_coverage(a.where("i < 5"), b.where("j >= 200"), 30.0, ("ra", "dec", "r2", "d2"), "i", "j").collect()}
    for i in range(5):
        assert cover[i].status == "absent" and cover[i].source_object_id is None and abs(cover[i].separation_arcsec - apart[i, 200:].min()) < 1e-5
    raises("reaches 2", lambda: sphere.untruncated(sphere.nearest(a, b, 4000.0, ("ra", "dec", "r2", "d2"), "i", "j", 2), 2).collect())


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 30_000])
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    values = {0: rng.lognormal(0, 4, n), 1: np.where(rng.random(n) < 0.7, 3.25, rng.normal(size=n)), 2: np.full(n, 1.5)}
    at = [0.0, 0.001, 0.25, 0.5, 0.9, 0.9999, 1.0]
    df = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs] + [(0, None), (3, None)], "g int, x double").repartition(5)
    got = {(r.g, r.k): r.value for r in order.quantiles(df, ["g"], "x", at).collect()}
    assert set(got) == {(g, k) for g in values for k in range(len(at))}
    for g, xs in values.items():
        assert np.allclose([got[g, k] for k in range(len(at))], np.quantile(xs, at), rtol=1e-12)
    assert np.isclose(order.quantiles(df.where("g < 1"), [], "x", [0.5]).first().value, np.median(values[0]))


def test_ranks_and_totals_in_buckets(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(o), float(v)) for g, o, v in zip(rng.integers(0, 3, 900) // 2, rng.permutation(900), rng.integers(0, 50, 900), strict=True)]
    df = spark.createDataFrame(rows, "g int, o int, v double").repartition(6)
    got = {(r.g, r.o): r.t for r in order.running_sum(df, ["g"], "o", "v", "t").collect()}
    for g in (0, 1):
        mine, total = sorted((o, v) for h, o, v in rows if h == g), 0.0
        for o, v in mine:
            total += v
            assert got[g, o] == total
    ranks = {(r.g, r.o): r.k for r in order.ranked(df, ["g"], F.col("o") % 1 + F.floor(F.col("o") / 100), [F.col("o")], "k").collect()}
    assert all(ranks[g, o] == 1 + sum(1 for h, p, _ in rows if h == g and p < o) for g, o, _ in rows)


def test_top_scores_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(260, 6)), 1)
    v[100:160] = v[0]  # many equal scores
    df = spark.createDataFrame([(k, x.tolist(), k % 3) for k, x in enumerate(v)], "id long, v array<double>, g int").repartition(4)
    q = df.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    for by in (None, "g"):
        got = {}
        for r in retrieval.top_scores(q, df, "qid", "qv", "id", "v", 5, ["g"], by).collect():
            got.setdefault((r.qid, r.g if by else 0), []).append((r.rank, r.id, r.score))
        for i in range(0, 260, 20):
            for g in range(3 if by else 1):
                near = sorted((-round(float(v[i] @ v[j]), 6), j) for j in range(260) if j != i and (not by or j % 3 == g))[:5]
                assert [(j, -s) for s, j in near] == [(j, s) for _, j, s in sorted(got[i, g])]


def test_probes_against_closed_forms(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 6))
    y = x @ rng.normal(size=6) + 0.3 * rng.normal(size=240)
    label = (x[:, 0] + 0.2 * rng.normal(size=240) > 0).astype(int)
    df = spark.createDataFrame([(k, r.tolist(), float(t), int(c), k % 3) for k, (r, t, c) in enumerate(zip(x, y, label, strict=True))], "id long, v array<double>, y double, c int, fold int")
    parts = {"a": [0, 1, 2], "both": list(range(6))}
    got = probes.modality_comparison(df, "id", "v", "y", parts, [0, 1], 0.7, 3, [0.1, 10.0]).collect()
    for seed in (0, 1):
        test = {int(r.object_id) for r in got if r.split_seed == seed}
        train = [k for k in range(240) if k not in test]
        for name, dims in parts.items():
            mine = [r for r in got if r.split_seed == seed and r.encoder == name]
            assert {r.hyperparameter_value for r in mine} <= {0.1, 10.0} and len(mine) == len(test)
            z, mean, std = x[:, dims], x[np.ix_(train, dims)].mean(0), x[np.ix_(train, dims)].std(0)
            z = (z - mean) / std
            w = np.linalg.solve(z[train].T @ z[train] + mine[0].hyperparameter_value * np.eye(len(dims)), z[train].T @ (y[train] - y[train].mean()))
            assert np.allclose([r.y_pred_numeric for r in mine], [z[int(r.object_id)] @ w + y[train].mean() for r in mine])
    train, test = df.where("id >= 60"), df.where("id < 60")
    near = probes.neighbours(train, test, "id", "v", "y", 4).groupBy("id").agg(F.avg("y").alias("p")).collect()
    z = (x - x[60:].mean(0)) / x[60:].std(0)
    z = (z / np.linalg.norm(z, axis=1)[:, None]).astype("f4").astype("f8")
    for r in near:
        best = sorted((-round(float(z[r.id] @ z[j]), 6), j) for j in range(60, 240))[:4]
        assert np.isclose(r.p, np.mean([y[j] for _, j in best]))
    assert probes.select_c(train, "v", "c", "fold", [0.01, 1.0]) in (0.01, 1.0)
    said = probes.logistic_probe(train, test, "v", "c", 1.0, [1, 0, 7]).collect()
    assert np.mean([r.prediction == r.c for r in said]) > 0.85 and all(abs(sum(r.probabilities) - 1) < 1e-9 and r.probabilities[2] == 0 for r in said)
    suite = probes.probe_suite(train, test, "id", "v", "y", None, "fold", [1.0], [], 4, "e", "r", 3)
    assert tuple(suite.columns) == probes.PREDICTIONS and suite.count() == 120


def test_generation_resumes_and_stops(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(40)], "object_id int, text string")
    made = []

    def fail_odd(t):
        if int(t[1:]) % 2:
            raise ValueError(t)
        return t

    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    assert generate.append_results(spark, rows.where("object_id < 10"), "object_id", "text", fail_odd, good, bad, 0.5) == {"completed": 5, "errors": 5, "pending": 0}
    assert generate.append_results(spark, rows, "object_id", "text", lambda t: t, good, bad, 0.5)["completed"] == 35
    raises("errors", lambda: generate.append_results(spark, rows, "object_id", "text", fail_odd, f"{tmp_path}/g", f"{tmp_path}/b", 0.1))
    assert spark.read.parquet(f"{tmp_path}/g", f"{tmp_path}/b").count() < 40  # it stopped before the last wave
    raises("not expected", lambda: generate.append_results(spark, rows.where("object_id > 3"), "object_id", "text", fail_odd, good, bad, 0.5))
    parsed = generate.generated(rows.limit(2), "object_id", "text", lambda t: "{}", lambda r: json.loads(r)["x"]).collect()
    assert not made and all(r.response is None and "KeyError" in r.error for r in parsed)
    vec = generate.encoded(rows, "object_id", "text", lambda: lambda ts: [[len(t), 1.0] for t in ts], 2).collect()
    assert len(vec) == 40 and all(list(r.embedding) == [2.0 if r.object_id < 10 else 3.0, 1.0] for r in vec)
    raises("2 numbers", lambda: generate.encoded(rows, "object_id", "text", lambda: lambda ts: [[1.0] for _ in ts], 2).collect())


def test_stream_skips_or_refuses_repeated_keys(spark, tmp_path):
    at = f"{tmp_path}/in"
    batch = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "object_id int, text string").coalesce(1).write.mode("append").parquet(at)

    def run(name, make, **kw):
        stream = spark.readStream.schema("object_id int, text string").option("maxFilesPerTrigger", 1).parquet(at)
        generate.stream_results(stream, "object_id", "text", make, f"{tmp_path}/{name}/g", f"{tmp_path}/{name}/b", f"{tmp_path}/{name}/c", **kw).awaitTermination()

    batch(1, 2)
    run("skip", lambda t: t)
    batch(2, 3)
    run("skip", lambda t: t + "!")
    assert {(r.object_id, r.response) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/skip/g").collect()} == {(1, "t1"), (2, "t2"), (3, "t3!")}
    raises("both sides", lambda: run("raise", lambda t: t, repeats="raise"))
    raises("errors", lambda: run("budget", lambda t: "", errors_allowed=1))


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "t.jsonl").write_text('{"object_id": "a"}\n\n{"object_id": "a"}\n{"object_id": "b"}\n')
    assert [tuple(r) for r in tables.read_table(spark, f"{tmp_path}/t.csv", ["b", "a"], "a int, b string").collect()] == [("x", 1), ("y", 2)]
    raises("missing columns", lambda: tables.read_table(spark, f"{tmp_path}/t.csv", ["z"]))
    assert sorted(r[0] for r in tables.done_ids(spark, f"{tmp_path}/t.jsonl").collect()) == ["a", "b"] and tables.done_ids(spark, f"{tmp_path}/none.jsonl").count() == 0
    rows = tables.query_rows(spark, {"lens": ["a", "b"]})
    assert [tuple(r) for r in rows.collect()] == [("lens:0", "lens", "canonical", "a"), ("lens:1", "lens", "paraphrase_1", "b")]
    source = spark.range(5).select(F.col("id").alias("k"))
    assert tables.select_ids(source, source.where("k < 2"), "k").count() == 2
    raises("ids without a row", lambda: tables.select_ids(source, spark.range(7).select(F.col("id").alias("k")), "k"))
    stat = tables.word_stats(spark.createDataFrame([("a b",), (" c ",), ("",), ("d e f g",)], "t string"), "t").first()
    assert (stat.mean, stat.median, stat.max) == (1.75, 1.5, 4)


def test_cells_are_read_once_and_results_written(spark, tmp_path):
    root, kept = f"{tmp_path}/cat", f"{tmp_path}/kept"
    for order_, pixel in ((5, 7), (5, 20_001)):
        spark.range(10).select((F.col("id") + pixel).alias("id"), F.lit(1.0).alias("z"), F.lit("x").alias("unused")).write.parquet(f"{root}/{tables.cell_path(order_, pixel)}")
    ids = spark.createDataFrame([(8,), (20_003,), (99,)], "id long")
    get = lambda cells: sorted(tuple(r) for r in tables.read_cells(spark, root, cells, ["id", "z"], ids, "id", kept).collect())
    assert get([(5, 7)]) == [(8, 1.0)]
    spark.range(0).select("id", F.lit(1.0).alias("z")).write.mode("overwrite").parquet(f"{root}/{tables.cell_path(5, 7)}")
    assert get([(5, 7), (5, 20_001)]) == [(8, 1.0), (20_003, 1.0)]  # the first cell is not read again
    assert tables.first_present(ids, spark.createDataFrame([(99,), (5,)], "id long"), "id").collect()[0].id == 99
    raises("expected", lambda: validation.require_rows(ids, 2))
    tables.write_evaluation([ids, ids], ids.limit(1), f"{tmp_path}/e")
    tables.write_audit(ids, ids.limit(1), f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/e/ranked").count() == 6 and spark.read.csv(f"{tmp_path}/a/rows", header=True).count() == 3
    raises("no <x>", lambda: text.filled("t", "<x>", F.lit("v")))


def test_caches(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", [3.0, 4.0]), ("b", "y", [0.0, 1.0])], "id string, t string, v array<double>")
    cache = caches.ingest(rows, "id", "t", "v", "m", "r")
    raises("not normalized", lambda: validation.validate_embedding_cache(cache))
    unit = caches.renormalized(cache)
    assert caches.write(unit, f"{tmp_path}/c")["n_rows"] == 2 and tables.verified(spark, f"{tmp_path}/c").count() == 2
    assert {tuple(round(x, 6) for x in r.embedding) for r in unit.collect()} == {(0.6, 0.8), (0.0, 1.0)}
    raises("exists", lambda: caches.write(unit, f"{tmp_path}/c"))
    assert caches.subset(spark, f"{tmp_path}/c", spark.createDataFrame([("b",)], "object_id string")).count() == 1
    assert caches.fingerprint_rows(unit).select("row_hash").distinct().count() == 2
    raises("no direction", lambda: caches.renormalized(cache.withColumn("embedding", F.array(F.lit(0.0).cast("float")))).collect())
    raises("duplicate", lambda: validation.validate_embedding_cache(unit.union(unit)))


def test_pairing(spark):
    row = lambda s, d, z=0.1: (s, d, 1, 10.0, 20.0, z, 0.01, 0.5)
    make = lambda *x: spark.createDataFrame(list(x), "source_object_id string, desi_object_id string, source_row_id long, desi_ra double, desi_dec double, desi_z double, desi_zerr double, separation_arcsec double")
    assert pairing.paired_manifest(make(row("a", "1"), row("b", "2"))).columns[:3] == ["object_id", "image_object_id", "spectrum_object_id"]
    raises("duplicate", lambda: pairing.paired_manifest(make(row("a", "1"), row("b", "1"))))
    raises("z not finite", lambda: pairing.paired_manifest(make(row("a", "1", float("nan")))))
    raises("missing columns", lambda: pairing.named_matches(make(row("a", "1")), dict.fromkeys(pairing.LEFT, "x"), dict.fromkeys(pairing.RIGHT, "y")))
    s = lambda wave, n=2: ("o", ([1.0] * n, wave, [1.0] * n, [False] * n))
    kind = "id string, s struct<flux: array<double>, wave: array<double>, ivar: array<double>, mask: array<boolean>>"
    get = lambda *x: pairing.spectra(spark.createDataFrame(list(x), kind), "id", "s", "flux", "wave", "ivar", "mask")
    assert get(s([1.0, 2.0]), s([1.0, 2.0 + 1e-9]))[0].count() == 2
    raises("grid", lambda: get(s([1.0, 2.0]), s([1.0, 3.0])))
    raises("lengths", lambda: get(s([1.0, 2.0]), s([1.0, 2.0], 3)))
    manifest, source = spark.createDataFrame([(0, "a"), (1, "c")], "row long, id string"), spark.createDataFrame([(0, "a", [1.0]), (1, "b", [1.0])], "place long, id string, v array<double>")
    assert pairing.rows_by_place(manifest.where("row = 0"), source, "row", "place", "id", "v", 1).count() == 1
    raises("another id at 1", lambda: pairing.rows_by_place(manifest, source, "row", "place", "id", "v", 1).collect())


def test_guards(spark):
    df = spark.createDataFrame([("a", "matched", None), ("b", "absent", None)], "id string, status string, source_object_id string")
    raises("matched without a source", lambda: validation.coverage(df, 2))
    raises("rows", lambda: validation.coverage(df.where("id = 'b'"), 2))
    v = spark.createDataFrame([("q", 0.7, True), ("q", 0.2, False), ("p", 0.9, False)], "q string, s double, b boolean")
    raises("differ", lambda: validation.same_target(v, F.col("s"), 0.6, F.col("b")))
    assert validation.expected_positives(v, "q", F.col("b"), {"q": 1}).count() == 3
    raises("positives", lambda: validation.expected_positives(v, "q", F.col("b"), {"q": 1, "none": 2}))
    splits = spark.createDataFrame([(1, 0, "test"), (2, 0, "train")], "id int, seed int, split string")
    said = spark.createDataFrame([(1, 0, "e")], "id int, seed int, enc string")
    assert validation.held_out_predictions(said, splits, "id", "enc", "seed").count() == 1
    raises("not held out", lambda: validation.held_out_predictions(said.union(spark.createDataFrame([(2, 0, "e")], said.schema)), splits, "id", "enc", "seed"))
    raises("missing", lambda: validation.held_out_predictions(said.union(spark.createDataFrame([(1, 1, "e")], said.schema)), splits.withColumn("seed", F.lit(2)), "id", "enc", "seed"))
    raises("sets differ", lambda: validation.same_keys(splits, said, "id"))
    raises("found 3", lambda: retrieval.fold_summary(spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0)], "q int, f int, v double"), ["q"], "f", "v").collect())
    assert stats.all_passed(v, ["q"], F.col("b")).where("all_passed").count() == 0
