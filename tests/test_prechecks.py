"""Grids of penalties on cached vectors against a plain refit; coverage of pairs by a catalog against a loop, and their guards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from asterfold.operators import heads, prechecks, probes, validation

PARTS = {"a": [0, 1], "b": [2, 3], "ab": [0, 1, 2, 3]}


@pytest.fixture(scope="module")
def cached(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = 3 + x @ [0.3, 0.0, 0.2, 0.1] + 0.4 * rng.normal(size=300)
    return spark.createDataFrame([(k, r.tolist(), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, y double")


def run(cached, **over):
    given = dict(contrasts={"ab_vs_a": ("a", "ab"), "ab_vs_b": ("b", "ab")}, seeds=[0, 1], train_ratio=0.7, folds=3, before=[0.1, 1.0], after=[0.1, 1.0, 1e5], samples=40, draw=7) | over
    return prechecks.alpha_sensitivity(cached, "id", "v", "y", PARTS, **given)


def test_grids_share_passes_and_agree_with_a_fit_each(cached):
    both = probes.modality_grids(cached, "id", "v", "y", PARTS, [0, 1], 0.7, 3, {"one": [1.0], "two": [1e5, 0.1]})
    for grid, alphas in {"one": [1.0], "two": [0.1, 1e5]}.items():
        alone = probes.modality_comparison(cached, "id", "v", "y", PARTS, [0, 1], 0.7, 3, alphas)
        rows = lambda df: sorted((r.object_id, r.encoder, r.split_seed, round(r.y_pred_numeric, 9), r.hyperparameter_value) for r in df.collect())
        assert rows(both.where(F.col("grid") == grid).drop("grid")) == rows(alone)
    with pytest.raises(ValueError, match="empty"):
        heads.fit_grids(cached, "v", ["y"], PARTS, "id", "id", 3, {"none": []})


def test_contrasts_before_and_after(cached):
    got = run(cached)
    said = got.predictions.collect()
    of = {(r.grid, r.encoder, r.split_seed, r.object_id): abs(r.y_pred_numeric - r.y_true_numeric) / (1 + r.y_true_numeric) for r in said}
    for row in [r for r in got.contrasts.collect() if r.scale == "one_plus_z"]:
        base = row.comparison[-1]
        for grid in ("before", "after"):
            mine = {}
            for (g, e, s, k), off in of.items():
                if g == grid and e == base:
                    mine.setdefault(k, []).append(off - of[g, "ab", s, k])
            assert np.isclose(row[grid], np.mean([np.mean(m) for m in mine.values()]), atol=2e-6) and row.objects == len(mine)
        assert np.isclose(row.change, row.after - row.before, atol=3e-6) and row.change_low <= row.change <= row.change_high
        assert row.holds == (row.decision_before == row.decision_after)
    chosen = {(r.grid, r.encoder, r.split_seed): r for r in got.selection.collect()}
    assert len(chosen) == 12 and all(r.at_grid_max == (r.hyperparameter_value == (1.0 if r.grid == "before" else 1e5)) for r in chosen.values())
    assert got.contrasts.first().selected_at_new_max == sum(r.at_grid_max for r in chosen.values() if r.grid == "after")


def test_the_same_grid_changes_nothing(cached):
    for r in run(cached, after=[0.1, 1.0]).contrasts.collect():
        assert r.holds and r.change == r.change_low == r.change_high == 0 and r.before == r.after


def test_cached_vectors_are_checked(cached):
    picked = lambda name: cached.select(F.col("id").alias("object_id"), F.array(*[F.col("v")[d] for d in PARTS[name]]).alias("vector"))
    prints = {n: validation.fingerprint(picked(n)).first().asDict() for n in PARTS}
    prechecks.require_prints(cached, "id", "v", PARTS, prints)
    changed = cached.withColumn("v", F.when(F.col("id") == 5, F.transform("v", lambda x: x + 1e-6)).otherwise(F.col("v")))
    with pytest.raises(ValueError, match="changed"):
        run(changed, prints=prints)
    with pytest.raises(ValueError, match="unknown"):
        run(cached, prints={"c": prints["a"]})
    with pytest.raises(ValueError, match="duplicate"):
        run(cached.unionByName(cached.where("id = 1")))
    with pytest.raises(ValueError, match="conditions"):
        run(cached, contrasts={"x": ("a", "c")})


def sky(spark, pairs, stars):
    return spark.createDataFrame(pairs, "pair string, ra double, dec double, z double"), spark.createDataFrame(stars, "star string, sra double, sdec double, f double, g double")


def audit(p, c, **over):
    labels = {"f": F.col("f") >= 0.7, "fg": (F.col("f") >= 0.7) & (F.col("g") >= 0.7)}
    given = dict(radius_arcsec=2.0, on=("ra", "dec", "sra", "sdec"), pair_id="pair", catalog_id="star", value="z", labels=labels, edges=[0.0, 0.1, 0.4, 0.5]) | over
    return prechecks.coverage_audit(p, c, **given)


def test_coverage_against_a_loop(spark):
    rng = np.random.default_rng(9)
    pairs = [(f"p{k:03}", float(k), float(k % 80), float(z)) for k, z in enumerate(rng.uniform(-0.05, 0.45, 200))]
    stars = [(f"s{k:03}", p[1] + 1 / 3600 / 2, p[2], float(rng.uniform()) if k % 7 else None, float(rng.uniform()) if k % 11 else float("nan")) for k, p in enumerate(pairs) if k % 3]
    p, c = sky(spark, pairs, stars)
    got = audit(p, c)
    by = {int(s[0][1:]): s for s in stars}
    flag = lambda k, both: (by[k][3] or 0) >= 0.7 and (not both or by[k][4] >= 0.7 or by[k][4] != by[k][4])  # noqa: E731  NaN is the largest value of a plain comparison
    for r in got.counts.collect():
        n = sum(flag(k, r.label == "fg") for k in by)
        assert (r.positive_objects, r.fraction_of_matches, r.fraction_of_all_pairs) == (n, round(n / len(by), 6), round(n / 200, 6))
    cells = {(r.low, r.high, r.label): r for r in got.crosstab.collect()}
    assert len(cells) == 6
    for (low, high, label), r in cells.items():
        inside = [k for k, q in enumerate(pairs) if low <= q[3] < high]
        assert (r.total_objects, r.matched_objects, r.positive_objects) == (len(inside), sum(k in by for k in inside), sum(k in by and flag(k, label == "fg") for k in inside))
        assert r.match_fraction == (round(r.matched_objects / r.total_objects, 6) if inside else 0)
    s = got.summary.first()
    off = sorted(r.separation_arcsec for r in got.labelled.collect())
    assert (s.total_pairs, s.matched_pairs, s.shared_assignments, s.pairs_outside_bins) == (200, len(by), 0, sum(not 0 <= q[3] < 0.5 for q in pairs))
    assert np.isclose(s.separation_median, np.median(off), atol=1e-6) and np.isclose(s.separation_p95, np.quantile(off, 0.95), atol=1e-6) and s.separation_max == off[-1]
    assert {r.pair for r in got.unmatched.collect()} == {f"p{k:03}" for k in range(0, 200, 3)} and got.unmatched.columns == p.columns


def test_coverage_without_matches_or_rows(spark):
    p, c = sky(spark, [("a", 10.0, 10.0, 0.2)], [("s", 50.0, 10.0, 0.9, 0.9)])
    s = audit(p, c).summary.first()
    assert (s.total_pairs, s.matched_pairs, s.coverage_fraction, s.separation_median, s.separation_max) == (1, 0, 0.0, None, None)
    none = audit(p.limit(0), c)
    assert none.summary.first().total_pairs == 0 and {r.fraction_of_all_pairs for r in none.counts.collect()} == {0.0} and none.crosstab.count() == 6


def test_coverage_guards(spark):
    p, c = sky(spark, [("a", 10.0, 10.0, 0.2), ("b", 10.0001, 10.0, 0.3)], [("s", 10.0, 10.0, 0.9, 0.9)])
    with pytest.raises(ValueError, match="duplicate"):
        audit(p, c)
    assert audit(p, c, shared=True).summary.first().shared_assignments == 1
    for over, said in (({"edges": [0.0, 0.0]}, "ascend"), ({"edges": [0.1]}, "ascend"), ({"expected_pairs": 3}, "counts"), ({"catalog_print": {"n_rows": 2}}, "named")):
        with pytest.raises(ValueError, match=said):
            audit(p, c, shared=True, **over)
    for bad in (p.withColumn("z", F.lit(float("nan"))), p.withColumn("z", F.lit(None).cast("double")), p.withColumn("pair", F.when(F.col("pair") == "a", F.col("pair")))):
        with pytest.raises(ValueError, match="rows break"):
            audit(bad, c, shared=True)
