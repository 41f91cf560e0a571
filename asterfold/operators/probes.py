"""Linear probes over array features with a Gram matrix from partial sums; fixed folds; trivial baselines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterfold.functions import hashing, vectors
from asterfold.operators import retrieval


def gram(df: DataFrame, vector: str, target: str, by: str) -> dict[int, np.ndarray]:
    """Per value of `by` the matrix Z'Z with Z = [1, x, y]: one (d + 2)^2 matrix a partition and group, summed."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for g, rows in frame.groupby(by):
                z = np.column_stack([np.ones(len(rows)), np.stack(rows[vector].to_numpy()).astype("f8"), rows[target].to_numpy("f8")])
                sums[g] = sums.get(g, 0) + z.T @ z
        if sums:
            yield pd.DataFrame({"g": list(sums), "k": 0, "m": [m.ravel() for m in sums.values()]})

    parts = df.select(vector, target, F.col(by).cast("long").alias(by)).mapInPandas(part, "g long, k int, m array<double>")
    summed = parts.select("g", F.posexplode("m").alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("x")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
    out = {}
    for row in summed.collect():  # one small matrix a fold
        m = np.array([c.x for c in row.m])
        out[row.g] = m.reshape(int(round(len(m) ** 0.5)), -1)
    return out


def ridge_solve(m: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights of ridge on features standardized by the training rows (population std, 0 as 1)."""
    n, sx, sy = m[0, 0], m[0, 1:-1], m[0, -1]
    mean, var = sx / n, np.maximum(np.diag(m)[1:-1] / n - (sx / n) ** 2, 0)
    scale = np.where(var > 1e-24, np.sqrt(var), 1.0)
    xx = (m[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(scale, scale)
    xy = (m[1:-1, -1] - mean * sy) / scale
    w = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy) / scale
    return float(sy / n - w @ mean), w


def select_alpha(df: DataFrame, vector: str, target: str, fold: str, grid: list[float], per: dict[int, np.ndarray] | None = None) -> float:
    """Lowest mean over folds of the MAE, ties to the smaller alpha. One Gram pass serves the whole grid."""
    per = per or gram(df, vector, target, fold)
    models = {(a, k): ridge_solve(sum(m for j, m in per.items() if j != k), a) for a in grid for k in per}
    score = df.groupBy(fold).agg(*[F.avg(F.abs(_predict(vector, {k: models[a, k] for k in per}, fold) - F.col(target))).alias(f"a{i}") for i, a in enumerate(grid)]).collect()
    means = [np.mean([row[f"a{i}"] for row in score]) for i in range(len(grid))]
    return grid[min(range(len(grid)), key=lambda i: (round(means[i], 12), grid[i]))]


def _predict(vector: str, models: dict[int, tuple[float, np.ndarray]], fold: str | None = None):
    def one(b: float, w: np.ndarray):
        return F.lit(b) + F.aggregate(F.zip_with(F.col(vector), F.lit(w.tolist()), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    if fold is None:
        return one(*next(iter(models.values())))
    out = None
    for k, (b, w) in models.items():
        out = F.when(F.col(fold) == k, one(b, w)) if out is None else out.when(F.col(fold) == k, one(b, w))
    return out


def ridge_probe(train: DataFrame, test: DataFrame, vector: str, target: str, fold: str, grid: list[float]) -> DataFrame:
    """test with prediction and the chosen alpha."""
    per = gram(train, vector, target, fold)
    alpha = select_alpha(train, vector, target, fold, grid, per)
    model = ridge_solve(sum(per.values()), alpha)
    return test.withColumns({"prediction": _predict(vector, {0: model}), "alpha": F.lit(float(alpha))})


def moments(train: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Mean and population std (0 as 1) of each dimension over the training rows."""
    rows = train.select(F.posexplode(vector).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("d").collect()
    return [r.m for r in rows], [r.s or 1.0 for r in rows]


def standardized(vector: str, mean: list[float], scale: list[float]) -> Column:
    centred = F.zip_with(F.col(vector), F.lit(mean), lambda x, m: x - m)
    return F.zip_with(centred, F.lit(scale), lambda x, s: x / s)


def logistic_probe(train: DataFrame, test: DataFrame, vector: str, label: str, c: float, labels: list[int] | None = None) -> DataFrame:
    """test with `prediction` by multinomial logistic regression, penalty 1 / (C n), on features standardized by the training rows.

    With labels also `probabilities` in their order, 0 for a label that the training rows lack.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    mean, scale = moments(train, vector)
    scaled = lambda df: df.withColumn("__f", array_to_vector(standardized(vector, mean, scale)))
    model = LogisticRegression(featuresCol="__f", labelCol=label, predictionCol="prediction", regParam=1 / (c * train.count()), standardization=False, family="multinomial", maxIter=200).fit(scaled(train))
    out = model.transform(scaled(test))
    if labels is not None:
        known = vector_to_array("probability")
        out = out.withColumn("probabilities", F.array(*[F.coalesce(F.get(known, F.lit(x)), F.lit(0.0)) for x in labels]))
    return out.drop("__f", "rawPrediction", "probability")


def select_c(train: DataFrame, vector: str, label: str, fold: str, grid: list[float]) -> float:
    """Highest mean over folds of the accuracy, ties to the smaller C; each fold's features are scaled by its own training rows."""
    from asterfold.operators import logistic

    return logistic.select_c(train, vector, label, fold, grid)


#: Columns of prediction rows.
PREDICTIONS = ("object_id", "encoder", "encoder_revision", "target", "probe_family", "split", "split_seed", "y_true_numeric", "y_pred_numeric", "y_true_label", "y_pred_label", "hyperparameter_name", "hyperparameter_value")


def prediction_rows(df: DataFrame, key: str, encoder: str, revision: str, target: str, family: str, seed: int, true: Column, said: Column, parameter: str, value: Column, numeric: bool) -> DataFrame:
    """The thirteen columns of a probe's test rows; numbers are null for labels, labels empty for numbers."""
    none, empty = F.lit(None).cast("double"), F.lit("")
    numbers, words = ((true.cast("double"), said.cast("double")), (empty, empty)) if numeric else ((none, none), (true.cast("string"), said.cast("string")))
    cells = [F.col(key).cast("string"), F.lit(encoder), F.lit(revision), F.lit(target), F.lit(family), F.lit("test"), F.lit(seed), *numbers, *words, F.lit(parameter), value.cast("double")]
    return df.select(*[c.alias(n) for c, n in zip(cells, PREDICTIONS, strict=True)])


def neighbours(train: DataFrame, test: DataFrame, key: str, vector: str, keep: str, k: int) -> DataFrame:
    """For each test row its k nearest training rows by the cosine of standardized features: key, `keep`, rank."""
    mean, scale = moments(train, vector)
    unit = lambda df: df.withColumn("__u", vectors.normalized(standardized(vector, mean, scale)))
    found = retrieval.top_scores(unit(test).select(F.col(key).alias("__query"), "__u"), unit(train), "__query", "__u", key, "__u", k, [keep])
    return found.drop(key).withColumnRenamed("__query", key)


def probe_suite(train: DataFrame, test: DataFrame, key: str, vector: str, value: str, label: str | None, fold: str, alphas: list[float], cs: list[float], k: int, encoder: str, revision: str, seed: int) -> DataFrame:
    """Prediction rows of a ridge and a kNN probe of `value`, and of a logistic and a kNN probe of `label` if there is one."""
    same = lambda df, *p: prediction_rows(df, key, encoder, revision, *p)
    ridge = ridge_probe(train, test, vector, value, fold, alphas)
    near = neighbours(train, test, key, vector, value, k).groupBy(key).agg(F.avg(value).alias("prediction")).join(test.select(key, value), key)
    out = same(ridge, value, "linear", seed, F.col(value), F.col("prediction"), "ridge_alpha", F.col("alpha"), True)
    out = out.unionByName(same(near, value, "knn", seed, F.col(value), F.col("prediction"), "k", F.lit(k), True))
    if label:
        c = select_c(train, vector, label, fold, cs)
        said = logistic_probe(train, test, vector, label, c).withColumn("prediction", F.col("prediction").cast("int"))
        voted = retrieval.vote(neighbours(train, test, key, vector, label, k), [key], label).join(test.select(key, label), key)
        out = out.unionByName(same(said, label, "linear", seed, F.col(label), F.col("prediction"), "logistic_c", F.lit(c), False))
        out = out.unionByName(same(voted, label, "knn", seed, F.col(label), F.col("prediction"), "k", F.lit(k), False))
    return out


def modality_comparison(df: DataFrame, key: str, vector: str, target: str, parts: dict[str, list[int]], seeds: list[int], train_ratio: float, folds: int, alphas: list[float]) -> DataFrame:
    """Prediction rows of ridge probes on parts of a fused vector, one condition each, over the same splits.

    parts: a condition's dimensions. Rows are repeated for each seed; heads.fit_grids takes two passes for all
    conditions, and one more predicts the test rows.
    """
    return modality_grids(df, key, vector, target, parts, seeds, train_ratio, folds, {"": alphas}).drop("grid")


def modality_grids(df: DataFrame, key: str, vector: str, target: str, parts: dict[str, list[int]], seeds: list[int], train_ratio: float, folds: int, grids: dict[str, list[float]]) -> DataFrame:
    """modality_comparison() under each named grid of alphas, told apart by `grid`, in the same three passes."""
    from asterfold.operators import heads

    each = df.select(key, vector, F.col(target).cast("double").alias("__y"), F.explode(F.array(*map(F.lit, seeds))).alias("split_seed"))
    each = each.withColumns({
        "__train": hashing.fraction(F.col(key), F.col("split_seed").cast("string")) < train_ratio,
        "__fold": F.floor(hashing.fraction(F.col(key), F.concat(F.lit("fold-"), F.col("split_seed").cast("string"))) * folds).cast("int")})
    found = heads.fit_grids(each.where("__train"), vector, ["__y"], parts, "split_seed", "__fold", folds, grids)
    tried = [(f"__{k}", grid, name) for k, (grid, name) in enumerate((g, n) for g in grids for n in parts)]
    columns = {c: {s: (found[grid][s, name, "__y"].constant, found[grid][s, name, "__y"].weights) for s in seeds} for c, grid, name in tried}
    said = heads.predicted(each.where(~F.col("__train")), vector, "split_seed", [key, "__y"], columns)
    alpha = lambda grid, name: F.create_map(*[x for s in seeds for x in (F.lit(s), F.lit(float(found[grid][s, name, "__y"].alpha)))])[F.col("split_seed")]
    rows = said.select(key, "split_seed", "__y", F.explode(F.array(*[F.struct(F.lit(grid).alias("grid"), F.lit(name).alias("encoder"), F.col(c).alias("p"), alpha(grid, name).alias("alpha")) for c, grid, name in tried])).alias("c"))
    return rows.select("c.grid", F.col(key).alias("object_id"), "c.encoder", "split_seed", F.col("__y").alias("y_true_numeric"), F.col("c.p").alias("y_pred_numeric"), F.col("c.alpha").alias("hyperparameter_value"))


def alpha_edges(predictions: DataFrame, alphas: list[float]) -> DataFrame:
    """Each condition's and seed's chosen alpha, and whether it lies at an end of the grid."""
    a = F.col("hyperparameter_value")
    return predictions.select("encoder", "split_seed", "hyperparameter_value").distinct().withColumns({"at_grid_min": a == float(min(alphas)), "at_grid_max": a == float(max(alphas))})


def pca(train: DataFrame, df: DataFrame, vector: str, k: int) -> DataFrame:
    """Projection on the first k components of the centred training rows; signs fixed by each largest weight."""
    m = sum(gram(train.withColumns({"__y": F.lit(0.0), "__g": F.lit(0)}), vector, "__y", "__g").values())
    n = m[0, 0]
    mean = m[0, 1:-1] / n
    values, basis = np.linalg.eigh(m[1:-1, 1:-1] / n - np.outer(mean, mean))
    basis = basis[:, np.argsort(-values)[:k]]
    basis *= np.sign(basis[np.abs(basis).argmax(axis=0), range(basis.shape[1])])
    parts = [F.round(_predict(vector, {0: (float(-mean @ basis[:, j]), basis[:, j])}), 6) for j in range(basis.shape[1])]
    return df.withColumn("projection", F.array(*parts))
