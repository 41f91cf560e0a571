"""Catalogs, caches in key order, derived caches, bins, samples and shared draws against brute force and damaged files."""

import glob
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from asterfold.functions import hashing
from asterfold.operators import bins, caches, stats
from asterfold.sources import catalog, tables


def damage(folder):
    for f in glob.glob(f"{folder}/**/*.parquet", recursive=True):
        with open(f, "wb") as out:
            out.write(b"damaged")


@pytest.fixture()
def sky(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.uniform(0, 360), rng.uniform(-80, 80), f"v{k}") for k in range(600)] + [(k, 10 + rng.random(), 20 + rng.random(), f"v{k}") for k in range(600, 900)]
    df = spark.createDataFrame(rows, "id long, ra double, dec double, v string")
    return rows, catalog.write_catalog(df, f"{tmp_path}/sky", "id", "ra", "dec", 1, 4, 60)


def kept_cells(spark, kept):
    return {(r.cell_order, r.cell_pixel) for r in spark.read.parquet(f"{kept}/ledger").collect()}


def test_only_the_targets_cells_are_read(spark, sky, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "CELLS_A_JOB", 2)
    rows, cat = sky
    assert cat.info.agg(F.sum("n_rows"), F.count("*")).first()[0] == 900 and cat.info.select("cell_order").distinct().count() == 2
    wanted = [r for r in rows if r[0] % 50 == 7 and r[1] < 100]
    targets = lambda some: spark.createDataFrame([r[:3] for r in some], "t long, a double, d double")
    asked = {(r.cell_order, r.cell_pixel) for r in catalog.asked_cells(cat, targets(wanted), "t", "a", "d")[1].collect()}
    every = {(r.cell_order, r.cell_pixel) for r in cat.info.collect()}
    assert 2 < len(asked) < len(every)
    for order, pixel in every - asked:  # reading any other cell would fail
        damage(f"{cat.path}/dataset/Norder={order}/Dir={pixel // 10_000 * 10_000}/Npix={pixel}")
    kept = f"{tmp_path}/kept"
    opened = catalog.open_catalog(spark, cat.path)
    get = lambda some: sorted(tuple(r) for r in catalog.read_targets(opened, targets(some), "t", "a", "d", ["v"], kept).collect())
    assert get(wanted) == sorted((r[0], r[3]) for r in wanted) and kept_cells(spark, kept) == asked
    damage(f"{cat.path}/dataset")  # from now on only kept rows can be read
    assert get(wanted) == sorted((r[0], r[3]) for r in wanted)
    with pytest.raises(Exception, match="(?i)parquet|damaged|footer"):
        get([*wanted, next(r for r in rows if r not in wanted and r[0] > 600)])


def test_a_stopped_run_goes_on(spark, sky, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "CELLS_A_JOB", 1)
    rows, cat = sky
    kept, targets = f"{tmp_path}/kept", spark.createDataFrame([r[:3] for r in rows if r[0] % 60 == 3], "t long, a double, d double")
    read, reads = catalog.pruned, []

    def stops(*a):
        if len(reads) == 3:
            raise RuntimeError("stopped")
        reads.append(1)
        return read(*a)

    monkeypatch.setattr(catalog, "pruned", stops)
    with pytest.raises(RuntimeError):
        catalog.read_targets(cat, targets, "t", "a", "d", ["v"], kept)
    done = kept_cells(spark, kept)
    assert len(done) >= 3
    for order, pixel in done:  # what is done is not read again
        damage(f"{cat.path}/dataset/Norder={order}/Dir={pixel // 10_000 * 10_000}/Npix={pixel}")
    monkeypatch.setattr(catalog, "pruned", read)
    found = catalog.read_targets(catalog.open_catalog(spark, cat.path), targets, "t", "a", "d", ["v"], kept)
    assert kept_cells(spark, kept) > done
    assert sorted(r.id for r in found.collect()) == [r[0] for r in rows if r[0] % 60 == 3]


def test_targets_must_be_there_once(spark, sky, tmp_path):
    rows, cat = sky
    some = spark.createDataFrame([(5000, *rows[5][1:3])], "t long, a double, d double")
    with pytest.raises(ValueError, match="not found"):
        catalog.read_targets(cat, some, "t", "a", "d", ["v"], f"{tmp_path}/a")
    with pytest.raises(ValueError, match="duplicate"):
        catalog.read_targets(cat, some.union(some), "t", "a", "d", ["v"], f"{tmp_path}/b")
    twice = spark.createDataFrame([*rows, rows[7]], "id long, ra double, dec double, v string")
    with pytest.raises(ValueError, match="twice"):
        catalog.read_targets(catalog.write_catalog(twice, f"{tmp_path}/two", "id", "ra", "dec", 1, 4, 60), spark.createDataFrame([rows[7][:3]], "t long, a double, d double"), "t", "a", "d", ["v"], f"{tmp_path}/c")


def cache_of(spark, n):
    rows = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.concat(F.lit("t"), "id").alias("t"), F.array(F.lit(0.6), F.lit(0.8)).alias("v"))
    return caches.ingest(rows, "k", "t", "v", "m", "r")


def scanned(df):
    """Rows that the scan of a collected plan gave out: those of the row groups that it read."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []
    stack = [plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            out.append((node.metrics().apply("numOutputRows").value(), node.toString()))
        if "QueryStage" in name:
            stack.append(node.plan())
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    return out


@pytest.mark.parametrize("listed", [1000, 5])
def test_ids_reach_the_scan(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(caches, "GROUP_ROWS", 200)
    monkeypatch.setattr(caches, "LISTED", listed)
    caches.write_by_key(cache_of(spark, 4000), f"{tmp_path}/c")
    ids = spark.range(0, 4000, 300).select(F.sha2(F.col("id").cast("string"), 256).alias("object_id"))
    rows = spark.read.parquet(f"{tmp_path}/c").where(caches.key_filter(ids, "object_id"))
    (n, text), = scanned(rows)
    assert n <= 14 * 201 < 4000 and "PushedFilters" in text and ("In(object_id" in text or "object_id IN" in text if listed == 1000 else "GreaterThanOrEqual" in text)
    found = caches.subset(spark, f"{tmp_path}/c", ids)
    assert sorted(r.object_id for r in found.collect()) == sorted(r.object_id for r in ids.collect())
    with pytest.raises(ValueError):
        caches.subset(spark, f"{tmp_path}/c", ids.union(spark.createDataFrame([("none",)], "object_id string")))
    assert caches.subset(spark, f"{tmp_path}/c", ids.limit(0)).count() == 0


def test_derived_caches_know_their_source(spark, tmp_path):
    source, out = f"{tmp_path}/s", f"{tmp_path}/d"
    cache = cache_of(spark, 50)
    caches.write(cache, source)
    made = []

    def half(df):
        made.append(df.count())
        return df.withColumn("embedding", F.slice("embedding", 1, 1))

    run = lambda step="half": caches.derived(spark, source, out, half, step)
    assert run() == {"rows": 50, "made": 50, "kept": 0} and spark.read.parquet(out).where("size(embedding) = 1").count() == 50
    hidden = f"{tmp_path}/hidden"
    os.rename(source, hidden)  # an unchanged source isn't read at all
    assert run() == {"rows": 50, "made": 0, "kept": 50} and made == [50]
    os.rename(hidden, source)
    changed = cache.withColumn("text", F.when(F.col("text").isin("t3", "t4"), "new").otherwise(F.col("text"))).where("text != 't9'")
    caches.write(changed.unionByName(cache.limit(1).withColumn("object_id", F.lit("fresh"))), source, overwrite=True)
    assert run() == {"rows": 50, "made": 3, "kept": 47} and made == [50, 3]
    assert {r.object_id for r in spark.read.parquet(out).collect()} == {r.object_id for r in spark.read.parquet(source).collect()}
    with pytest.raises(ValueError, match="was made by"):
        run("other")
    caches.write(cache, source, overwrite=True)
    spark.read.parquet(source).limit(10).write.parquet(f"{tmp_path}/short")
    os.rename(source, hidden)
    os.rename(f"{tmp_path}/short", source)
    with pytest.raises(ValueError, match="fingerprint"):
        run()


@pytest.mark.parametrize("n", [0, 1, 7, 900])
def test_bins_against_all_pairs(spark, n):
    rng = random.Random(n)
    edges = [(k, *sorted((rng.gauss(0, 1), rng.gauss(0, 1) * 100))) for k in range(n)] + [(n, None, -1.0), (n + 1, 1.0, None), (n + 2, None, None), (n + 3, 2.0, 2.0), (n + 4, 3.0, 1.0), (n + 5, 0.0, 0.5)]
    values = [rng.gauss(0, 2) for _ in range(300)] + [e for _, *p in edges[:20] for e in p if e is not None] + [0.0] * 50 + [float("inf"), float("-inf"), float("nan"), None]
    table = spark.createDataFrame(edges, "b long, lo double, hi double")
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x double").repartition(3)
    inside = lambda x, lo, hi: x is not None and x == x and (lo is None or x >= lo) and (hi is None or x < hi) and (lo is None or hi is None or lo < hi)
    got = sorted((r.i, r.b) for r in bins.assigned(rows, "x", table, "lo", "hi").collect())
    assert got == sorted((i, b) for i, x in enumerate(values) for b, lo, hi in edges if inside(x, lo, hi))
    counted = {r.b: r.n for r in bins.counted(rows, "x", table, "lo", "hi", ["b", "lo", "hi"], n=F.lit(1)).collect()}
    assert counted == {b: sum(inside(x, lo, hi) for x in values) for b, lo, hi in edges}


def test_samples_are_exact_and_filtered(spark):
    df = spark.range(5000).withColumn("good", F.when(F.col("id") % 7 > 0, F.col("id") % 3 == 0))
    h = lambda k: (hashlib.sha256(f"s|{k}|4".encode()).hexdigest(), k)
    fit = [k for k in range(5000) if k % 7 and k % 3 == 0]
    for n in (1, 2, 500, len(fit)):
        got = [r.id for r in hashing.exact_sample(df, "id", n, "s", 4, F.col("good")).collect()]
        assert len(got) == n and set(got) == set(sorted(fit, key=h)[:n])
    with pytest.raises(ValueError, match="rows fit"):
        hashing.exact_sample(df, "id", len(fit) + 1, "s", 4, F.col("good"))
    plan = hashing.exact_sample(df, "id", 500, "s", 4)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "TakeOrdered" not in plan and "SinglePartition" not in plan
    alike = spark.createDataFrame([(1,), (1,), (1,), (2,)], "id int")
    assert hashing.exact_sample(alike, "id", 4, "s", 4).count() == 4


def test_shared_draws_give_each_contrast_its_own_interval(spark):
    rng = random.Random(1)
    rows = [(k, rng.gauss(0.2, 1), rng.gauss(0, 1) if k % 3 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    got = {r.contrast: r for r in stats.shared_bootstrap(df, "k", ["a", "b"], 40, 3).collect()}
    for c in ("a", "b"):
        alone = stats.bootstrap(df.where(f"{c} is not null").select("k", F.col(c).alias("t"), F.lit(1).alias("w")), "k", "t", "w", 40, 3).first()
        assert (got[c].estimate, got[c].ci_low, got[c].ci_high, got[c].objects) == (alone.estimate, alone.ci_low, alone.ci_high, alone.objects)


def test_constant_orders_are_spread(spark):
    """A constant order column is told apart by the key: ranks are right, and many tasks hold them."""
    from asterfold.operators import order

    df = spark.range(4000).select("id", F.lit(1.0).alias("x"), F.lit("g").alias("g"))
    laid = order.laid_out(df, ["g"], [F.col("x"), F.col("id")])
    sizes = [r["count"] for r in laid.groupBy("__part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2000
    ranks = order.ranked_along(df, ["g"], [F.col("x"), F.col("id")], "r").collect()
    assert all(r.r == r.id + 1 for r in ranks) and len(ranks) == 4000


def test_query_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"category": "lens", "texts": ["a", "b", "c"]}\n{"category": "bar", "texts": ["d"]}\n')
    rows = sorted(tuple(r) for r in tables.read_queries(spark, f"{tmp_path}/q.jsonl").collect())
    assert rows == [("bar:0", "bar", "canonical", "d"), ("lens:0", "lens", "canonical", "a"), ("lens:1", "lens", "paraphrase_1", "b"), ("lens:2", "lens", "paraphrase_2", "c")]
    (tmp_path / "e.jsonl").write_text('{"category": "lens", "texts": []}\n')
    with pytest.raises(ValueError, match="without texts"):
        tables.read_queries(spark, f"{tmp_path}/e.jsonl")
    (tmp_path / "t.jsonl").write_text('{"category": "x", "texts": ["a"]}\n' * 2)
    with pytest.raises(ValueError, match="duplicate"):
        tables.read_queries(spark, f"{tmp_path}/t.jsonl")
