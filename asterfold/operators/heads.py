"""Ridge heads of several targets on several parts of a fused vector, for several splits at once.

Two passes over the training rows serve every head: one sums the Gram matrix of (1, vector, targets) by split and fold,
of which each head's own is a block; one scores all penalties on the held-out folds by one matrix product a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asterfold.operators import probes


@dataclass(frozen=True)
class Head:
    """constant + weights @ vector; weights are zero outside the head's part."""

    constant: float
    weights: np.ndarray
    alpha: float


def grams(rows: DataFrame, vector: str, targets: list[str], by: str) -> dict[int, np.ndarray]:
    """Per value of `by` the matrix Z'Z with Z = [1, vector, targets]: a matrix a task and group is summed by rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z, own = _design(batch, len(targets)), batch.column(1).to_numpy()
            for g in np.unique(own):
                mine = z[own == g]
                sums[int(g)] = sums.get(int(g), 0) + mine.T @ mine
        for g, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, g)), pa.array(np.arange(m.size)), pa.array(m.ravel())], ["g", "at", "x"])

    selected = rows.select(vector, F.col(by).cast("long"), *[F.col(t).cast("double") for t in targets])
    summed = selected.mapInArrow(part, "g long, at long, x double").groupBy("g", "at").agg(F.sum("x").alias("x"))
    got = summed.toArrow()  # one small matrix a group
    g, at, x = (got.column(c).to_numpy() for c in ("g", "at", "x"))
    out = {}
    for k in np.unique(g):
        size = int(round((g == k).sum() ** 0.5))
        m = np.zeros(size * size)
        m[at[g == k]] = x[g == k]
        out[int(k)] = m.reshape(size, size)
    return out


def _design(batch: pa.RecordBatch, targets: int) -> np.ndarray:
    n = batch.num_rows
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(n, -1)
    y = [batch.column(2 + k).to_numpy(zero_copy_only=False).astype("f8") for k in range(targets)]
    return np.column_stack([np.ones(n), x, *y])


def _head(m: np.ndarray, dims: list[int], target: int, width: int, alpha: float) -> Head:
    own = [0, *[d + 1 for d in dims], 1 + width + target]
    constant, w = probes.ridge_solve(m[np.ix_(own, own)], alpha)
    full = np.zeros(width)
    full[dims] = w
    return Head(constant, full, alpha)


def _errors(rows: DataFrame, vector: str, targets: list[str], by: str, heads: dict[int, np.ndarray], of: list[int]) -> dict[int, np.ndarray]:
    """Per group the mean absolute error of each column of its (1 + width, heads) matrix; of: the target of each column."""
    shared = rows.sparkSession.sparkContext.broadcast(heads)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z, own = _design(batch, len(targets)), batch.column(1).to_numpy()
            for g in np.unique(own):
                mine, w = z[own == g], shared.value[int(g)]
                off = np.abs(mine[:, : len(w)] @ w - mine[:, len(w) :][:, of]).sum(axis=0)
                sums[int(g)] = sums.get(int(g), 0) + np.append(off, len(mine))
        for g, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), g)), pa.array(np.arange(len(s))), pa.array(s)], ["g", "at", "x"])

    selected = rows.select(vector, F.col(by).cast("long"), *[F.col(t).cast("double") for t in targets])
    got = selected.mapInArrow(part, "g long, at long, x double").groupBy("g", "at").agg(F.sum("x").alias("x")).orderBy("g", "at").toArrow()
    g, x = got.column("g").to_numpy(), got.column("x").to_numpy()
    return {int(k): x[g == k][:-1] / x[g == k][-1] for k in np.unique(g)}


def fit_heads(train: DataFrame, vector: str, targets: list[str], parts: dict[str, list[int]], seed: str, fold: str, folds: int, alphas: list[float]) -> dict[tuple[int, str, str], Head]:
    """The head of each (seed, part, target), with the alpha of the lowest mean error over folds, ties to the smaller.

    train: one row an object and seed, with its fold 0..folds-1. Features are standardized by each head's training rows.
    """
    return fit_grids(train, vector, targets, parts, seed, fold, folds, {"": alphas})[""]


def fit_grids(train: DataFrame, vector: str, targets: list[str], parts: dict[str, list[int]], seed: str, fold: str, folds: int, grids: dict[str, list[float]]) -> dict[str, dict[tuple[int, str, str], Head]]:
    """fit_heads() for several named grids of alphas, in the same two passes: every alpha is scored once, each grid picks among its own."""
    if not grids or not all(grids.values()):
        raise ValueError("a grid of alphas is empty")
    alphas = sorted({float(a) for g in grids.values() for a in g})
    rows = train.withColumn("__g", F.col(seed).cast("long") * folds + F.col(fold))
    whole = grams(rows, vector, targets, "__g")
    if not whole:
        raise ValueError("no training rows")
    width = next(iter(whole.values())).shape[0] - 1 - len(targets)
    trials = [(part, t, a) for part in parts for t in range(len(targets)) for a in alphas]
    held = {}
    for g in whole:
        others = [m for h, m in whole.items() if h != g and h // folds == g // folds]
        if not others:
            raise ValueError(f"only one fold of seed {g // folds} has rows")
        heads = [_head(sum(others), parts[part], t, width, a) for part, t, a in trials]
        held[g] = np.stack([np.append(h.constant, h.weights) for h in heads], axis=1)
    errors = _errors(rows, vector, targets, "__g", held, [t for _, t, _ in trials])
    out: dict[str, dict[tuple[int, str, str], Head]] = {name: {} for name in grids}
    for s in sorted({g // folds for g in whole}):
        mean = np.mean([e for g, e in errors.items() if g // folds == s], axis=0)
        total = sum(m for g, m in whole.items() if g // folds == s)
        for part in parts:
            for t, name in enumerate(targets):
                scored = [(round(mean[k], 12), a) for k, (p, u, a) in enumerate(trials) if (p, u) == (part, t)]
                for label, grid in grids.items():
                    alpha = min(x for x in scored if x[1] in set(map(float, grid)))[1]
                    out[label][s, part, name] = _head(total, parts[part], t, width, alpha)
    return out


def predicted(rows: DataFrame, vector: str, seed: str, keep: list[str], columns: dict[str, dict[int, tuple[float, np.ndarray]]]) -> DataFrame:
    """The kept columns and seed, and for each named column constant + weights @ vector by the row's seed."""
    names = list(columns)
    tables = {s: np.stack([np.append(*columns[c][s]) for c in names], axis=1) for s in next(iter(columns.values()))}
    shared = rows.sparkSession.sparkContext.broadcast(tables)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = [*keep, seed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            said = np.zeros((n, len(names)))
            if n:
                x = np.column_stack([np.ones(n), batch.column(len(kept)).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(n, -1)])
                own = batch.column(len(kept) - 1).to_numpy()
                for s in np.unique(own):
                    said[own == s] = x[own == s] @ shared.value[int(s)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(said[:, k]) for k in range(len(names)))], [*kept, *names])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"`{c}` double" for c in names)])
    return rows.select(*kept, vector).mapInArrow(run, schema)
