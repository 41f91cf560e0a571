"""Heads, joint retrieval, logistic grids and the spectrum encoder against closed forms and brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from asterfold.functions import scores, vectors
from asterfold.operators import encoder, heads, joint, logistic


def fraction(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16], 16) / 2.0**64


def ridge(x, y, alpha):
    """Predictor of ridge on standardized features."""
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 1e-12, std, 1)
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda v: (v - mean) / std @ w + y.mean()


def best_alpha(x, y, fold, alphas):
    def error(a):
        return np.mean([np.abs(ridge(x[fold != k], y[fold != k], a)(x[fold == k]) - y[fold == k]).mean() for k in np.unique(fold)])

    return min(alphas, key=lambda a: (round(error(a), 12), a))


def test_heads_are_closed_solutions(spark):
    rng = np.random.default_rng(4)
    n, parts, alphas = 240, {"a": [0, 1], "b": [2, 3, 4], "all": [0, 1, 2, 3, 4]}, [0.1, 10.0, 1000.0]
    x = rng.normal(size=(n, 5)) * [1, 5, 0.1, 1, 1] + [0, 3, 0, 0, 0]
    x[:, 3] = 2.0  # a feature without variance
    y, u = x @ rng.normal(size=5) + rng.normal(size=n), rng.normal(size=n)
    seed, fold = np.arange(n) % 2, (np.arange(n) // 2) % 3
    df = spark.createDataFrame([(r.tolist(), float(a), float(b), int(s), int(f)) for r, a, b, s, f in zip(x, y, u, seed, fold, strict=True)], "v array<double>, y double, u double, seed int, fold int").repartition(5)
    found = heads.fit_heads(df, "v", ["y", "u"], parts, "seed", "fold", 3, alphas)
    for s in (0, 1):
        mine = seed == s
        for part, dims in parts.items():
            for name, target in (("y", y), ("u", u)):
                head = found[s, part, name]
                assert head.alpha == best_alpha(x[mine][:, dims], target[mine], fold[mine], alphas)
                want = ridge(x[mine][:, dims], target[mine], head.alpha)(x[:, dims])
                assert np.allclose(head.constant + x @ head.weights, want)
    columns = {"p": {s: (found[s, "b", "y"].constant, found[s, "b", "y"].weights) for s in (0, 1)}}
    got = heads.predicted(df, "v", "seed", ["y"], columns).collect()
    want = {round(float(a), 9): found[s, "b", "y"].constant + r @ found[s, "b", "y"].weights for a, s, r in zip(y, seed, x, strict=True)}
    assert len(got) == n and all(np.isclose(r.p, want[round(r.y, 9)]) for r in got)


def galaxies(n=160):
    rng = np.random.default_rng(0)
    f, sp, z = rng.random((3, n)).round(3)
    image = np.stack([f, sp, rng.random(n)], 1) + 0.05 * rng.normal(size=(n, 3))
    spectrum = np.stack([z, rng.random(n)], 1) + 0.05 * rng.normal(size=(n, 2))
    return f, sp, z, image, spectrum


def test_joint_retrieval_against_brute_force(spark):
    f, sp, z, image, spectrum = galaxies()
    n, ids, reasons = len(f), [f"o{k:04d}" for k in range(len(f))], ["anchor_v1", "morphology_priority", "hash_fill"]
    both = np.minimum(f, sp)
    rows = [(ids[k], reasons[k % 3], float(z[k]), image[k].tolist(), spectrum[k].tolist(), float(f[k]), float(sp[k]), bool(f[k] >= 0.6), bool(both[k] >= 0.6)) for k in range(n)]
    schema = "object_id string, selection_reason string, z double, image array<double>, spectrum array<double>, f double, sp double, reliable_featured boolean, reliable_spiral boolean"
    manifest = spark.createDataFrame(rows, schema).repartition(3)
    strengths = {"featured": scores.path_strength(F.col("f")), "spiral": scores.path_strength(F.col("f"), F.col("sp"))}
    asked = [joint.Query("a", "t", "featured", 0.2, 0.6, int(((f >= 0.6) & (z >= 0.2) & (z < 0.6)).sum())), joint.Query("b", "t", "spiral", 0.4, 0.9, int(((both >= 0.6) & (z >= 0.4) & (z < 0.9)).sum()))]
    setup = joint.Setup((0, 1), 0.6, 3, (0.1, 1.0, 10.0), 3, 7, 0.6)
    out = joint.joint_retrieval(manifest, strengths, asked, setup)
    ranked, metrics = out.ranked.collect(), {(r.query_name, r.task, r.condition, r.split_seed, r.candidate_population): r for r in out.metrics.collect()}
    splits = {(r.object_id, r.split_seed): r.split for r in out.splits.collect()}
    alphas = {(r.condition, r.target, r.split_seed): r for r in out.selection.collect()}
    target = {"spec_z": z, "featured": f, "spiral": both}
    x = np.column_stack([image, spectrum])
    dims = {"image_only": [0, 1, 2], "spectrum_only": [3, 4], "image_plus_spectrum": [0, 1, 2, 3, 4]}
    for s in (0, 1):
        train = np.array([fraction(i, s) < 0.6 for i in ids])
        assert all(splits[i, s] == ("train" if t else "test") for i, t in zip(ids, train, strict=True))
        fold = np.array([math.floor(fraction(f"{i}|{s}", "fold-3") * 3) for i in ids])
        test = np.flatnonzero(~train)
        ring = sorted(test.tolist(), key=lambda k: (hashlib.sha256(f"{ids[k]}|derange-3".encode()).hexdigest(), ids[k]))
        partner = {k: ring[(p + 1) % len(ring)] for p, k in enumerate(ring)}
        assert all(k != p for k, p in partner.items())
        other = np.array([partner.get(k, k) for k in range(n)])
        said = {}
        for name, y in target.items():
            for part, d in dims.items():
                a = best_alpha(x[train][:, d], y[train], fold[train], setup.alphas)
                assert alphas[part, name, s].ridge_alpha == a and alphas[part, name, s].at_grid_max == (a == 10.0)
                said[part, name] = ridge(x[train][:, d], y[train], a)(x[:, d])
            whole = ridge(x[train], y[train], alphas["image_plus_spectrum", name, s].ridge_alpha)
            said["fusion_shuffled_image", name] = whole(np.column_stack([image[other], spectrum]))
            said["fusion_shuffled_spectrum", name] = whole(np.column_stack([image, spectrum[other]]))
        for q in asked:
            truth, inside = target[q.morphology], (z >= q.z_low) & (z < q.z_high)
            graded = {"morphology": truth, "redshift": inside.astype(float), "joint": truth * inside}
            hit = {"morphology": truth >= 0.6, "redshift": inside, "joint": (truth >= 0.6) & inside}
            near = lambda v, q=q: np.exp(-np.maximum(np.maximum(q.z_low - v, v - q.z_high), 0) / ((q.z_high - q.z_low) / 2))
            for task in joint.TASKS:
                for c in (*joint.MODELS, *joint.ABLATIONS, *joint.REFERENCES):
                    if c == "oracle":
                        score = graded[task]
                    elif c == "no_information":
                        score = np.array([fraction(3, s, q.name, task, i) for i in ids])
                    else:
                        m, v = np.clip(said[c, q.morphology], 0, 1), near(said[c, "spec_z"])
                        score = {"morphology": m, "redshift": v, "joint": m * v}[task]
                    mine = sorted((r for r in ranked if (r.query_name, r.task, r.condition, r.split_seed) == (q.name, task, c, s)), key=lambda r: r["rank"])
                    assert [r["rank"] for r in mine] == list(range(1, len(test) + 1))
                    assert all(abs(r.score - score[ids.index(r.object_id)]) < 1e-6 for r in mine)
                    assert [r.object_id for r in mine] == [r.object_id for r in sorted(mine, key=lambda r: (-r.score, r.object_id))]
                    top = [ids.index(r.object_id) for r in mine[:7]]
                    gain = lambda g: sum((2**v - 1) / math.log2(k + 2) for k, v in enumerate(g))
                    ideal = gain(sorted(graded[task][test], reverse=True)[:7])
                    got = metrics[q.name, task, c, s, "enriched_all"]
                    assert abs(got.ndcg_at_k - (gain(graded[task][top]) / ideal if ideal else 0)) < 2e-6 and got.relevant_objects == hit[task][test].sum()
                    assert abs(got.precision_at_k - hit[task][top].mean()) < 2e-6 and abs(got.top_k_morphology_strength - truth[top].mean()) < 2e-6
    less = {(r.query_name, r.split_seed, r.comparison): r.ndcg_at_k_difference for r in out.comparisons.collect()}
    assert len(less) == 2 * 2 * 4
    for (q, s, c), v in less.items():
        at = lambda name, q=q, s=s: metrics[q, "joint", name, s, "enriched_all"].ndcg_at_k
        assert abs(v - (at("image_plus_spectrum") - at(c.removeprefix("image_plus_spectrum_minus_")))) < 2e-6
    assert out.tables.count() == 2 * 3 * 7 * 3
    for wrong in (manifest.unionByName(manifest.limit(1)), manifest.withColumn("reliable_spiral", ~F.col("reliable_spiral")), manifest.withColumn("spectrum", F.when(F.col("object_id") > "o0100", F.array(F.lit(1.0))).otherwise(F.col("spectrum")))):
        with pytest.raises(ValueError):
            joint.joint_retrieval(wrong, strengths, asked, setup)
    with pytest.raises(ValueError):
        joint.joint_retrieval(manifest, strengths, [joint.Query("a", "t", "featured", 0.2, 0.6, 1)], setup)


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) * [1, 5, 0.1, 1, 1] + [0, 3, 0, 0, 0]
    label = (x[:, :3] @ rng.normal(size=(3, 3)) * 0.5 + rng.normal(size=(400, 3))).argmax(1)
    df = spark.createDataFrame([(k, r.tolist(), int(c) * 10, k % 4) for k, (r, c) in enumerate(zip(x, label, strict=True))], "id long, v array<double>, l int, fold int").repartition(5)
    return x, label, df


def test_logistic_grid_reaches_flat_slopes(spark, classes):
    x, label, df = classes
    labels, models = logistic.fit_grid(df, "v", "l", "fold", [0.01, 1.0, 100.0])
    assert labels == [0, 10, 20] and [(m.fold, m.c) for m in models] == [(k, c) for k in (0, 1, 2, 3, None) for c in (0.01, 1.0, 100.0)]
    for m in models:
        train = np.array([m.fold is None or k % 4 != m.fold for k in range(400)])
        z = np.column_stack([np.ones(train.sum()), (x[train] - x[train].mean(0)) / x[train].std(0)])
        p = np.exp(z @ m.weights.T)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), label[train]] -= 1
        slope = p.T @ z
        slope[:, 1:] += m.weights[:, 1:] / m.c
        assert m.done and np.abs(slope).max() < 1e-5 * train.sum()
    said = {r.id: r.said for r in logistic.predictions(df, "v", ["id"], labels, models).collect()}
    w = models[-1]
    z = np.column_stack([np.ones(400), (x - x.mean(0)) / x.std(0)])
    assert [said[k][-1] for k in range(400)] == (z @ w.weights.T).argmax(axis=1).tolist()
    rows = {(r.fold, r.c): r for r in logistic.accuracies(df, "v", "l", "fold", [0.01, 1.0, 100.0]).collect()}
    for j, m in enumerate(models[:12]):
        held = [k for k in range(400) if k % 4 == m.fold]
        assert rows[m.fold, m.c].n == 100 and np.isclose(rows[m.fold, m.c].accuracy, np.mean([said[k][j] == label[k] for k in held]))
    with pytest.raises(ValueError):
        logistic.fit_grid(df.withColumn("l", F.when(F.col("id") > 3, F.col("l"))), "v", "l", "fold", [1.0])


def test_logistic_jobs_do_not_grow_with_the_grid(spark, classes, monkeypatch):
    _, _, df = classes
    passes = []
    real = logistic._sums
    monkeypatch.setattr(logistic, "_sums", lambda *a: passes.append(1) or real(*a))
    logistic.fit_grid(df, "v", "l", "fold", [1.0], final=False)
    one = len(passes)
    passes.clear()
    logistic.fit_grid(df, "v", "l", "fold", [1.0, 0.9, 0.8, 0.7, 0.6], final=False)
    assert len(passes) <= one + 3


def spectra(spark, n=60):
    rng = np.random.default_rng(0)
    w = np.linspace(3600, 9800, 120)
    rows = [(k, (1 + 0.2 * np.sin(w / 300 + k) + 0.05 * rng.normal(size=120)).tolist(), (w + rng.random()).tolist()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, flux array<float>, wave array<double>").repartition(3)


def test_encoder_is_pca_and_reloads_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(encoder, "CHUNK", 7)
    rows, df = spectra(spark)
    model = encoder.SpectrumPca(components=4, pixels=40, window=7).fit(df)
    x = np.stack([encoder.continuum_free(encoder.on_grid(np.array(f, "f4").astype("f8"), np.array(v), model.grid)[None], 7)[0] for _, f, v in rows])
    basis = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:4]
    basis *= np.sign(basis[range(4), np.abs(basis).argmax(axis=1)])[:, None]
    got = {r.id: np.array(r.embedding) for r in model.transform(df).collect()}
    assert all(np.allclose(got[k], (x[k] - x.mean(0)) @ basis.T, atol=1e-4) for k in range(len(rows)))
    model.save(f"{tmp_path}/m")
    again = encoder.SpectrumPcaModel.load(f"{tmp_path}/m")
    assert again.revision == model.revision and again.uid == model.uid and again.getOrDefault("window") == 7
    assert all((got[r.id] == np.array(r.embedding)).all() for r in again.transform(df).collect())
    grid = np.linspace(3700, 9700, 12)  # the same features by column functions
    columns = df.select("id", vectors.continuum_log(vectors.resampled(F.col("flux"), F.col("wave"), F.array(*map(F.lit, grid.tolist()))), 5).alias("x")).collect()
    own = {k: encoder.continuum_free(encoder.on_grid(np.array(f, "f4").astype("f8"), np.array(v), grid)[None], 5)[0] for k, f, v in rows}
    assert all(np.allclose(r.x, own[r.id], atol=1e-9) for r in columns)
    encoder.SpectrumPca(components=3, pixels=16, window=3, outputCol="e").save(f"{tmp_path}/e")
    assert encoder.SpectrumPca.load(f"{tmp_path}/e").fit(df).transform(df.limit(0)).columns[-1] == "e"
    assert model.transform(df.limit(0)).count() == 0


def test_encoder_refuses_odd_spectra(spark):
    _, df = spectra(spark, 12)
    with pytest.raises(ValueError):
        encoder.SpectrumPca(components=20, pixels=40, window=7).fit(df)
    with pytest.raises(ValueError):
        encoder.SpectrumPca(components=2, pixels=40, window=6).fit(df)
    model = encoder.SpectrumPca(components=2, pixels=40, window=7).fit(df)
    for bad in (F.lit(None).cast("array<float>"), F.slice("flux", 1, 5), F.transform("flux", lambda x, i: F.when(i > 3, x))):
        with pytest.raises(Exception, match="flux and wave"):
            model.transform(df.withColumn("flux", bad)).collect()
