"""Multinomial logistic regressions of every fold and penalty at once: one pass over the rows a step, for all of them.

A step's job sums each model's loss and gradient, which are small whatever the rows are; the driver moves all models
by L-BFGS and the next job looks at their new places. The start of each inverse Hessian is the bound half of the
features' Gram matrix plus the penalty, known from one pass before, so few steps are needed. So the number of jobs
doesn't grow with folds or penalties, and features are scaled by each fold's own training rows without a copy of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asterfold.operators import probes

#: Tasks that add up the sums of all others, steps at most, remembered steps, and the slope (largest entry, a row) that counts as none.
ADDERS, STEPS, MEMORY, FLAT = 32, 200, 10, 1e-6


@dataclass
class Model:
    """One regression: held-out fold (None: fitted on all rows), C, moments of its training rows, weights (labels, 1 + d)."""

    fold: int | None
    c: float
    mean: np.ndarray
    scale: np.ndarray
    rows: float
    inverse: np.ndarray  # of the Hessian's bound
    weights: np.ndarray
    value: float = np.inf
    slope: np.ndarray | None = None
    trial: np.ndarray | None = None
    step: float = 1.0
    past: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    done: bool = False

    def raw(self, weights: np.ndarray) -> np.ndarray:
        """The same function of features as they are, the constant first."""
        w = weights[:, 1:] / self.scale
        return np.column_stack([weights[:, 0] - w @ self.mean, w])

    def penalized(self, loss: float, gradient: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and slope in scaled features of a summed loss and its gradient in raw ones."""
        slope = np.column_stack([gradient[:, 0], (gradient[:, 1:] - np.outer(gradient[:, 0], self.mean)) / self.scale])
        slope[:, 1:] += weights[:, 1:] / self.c
        return loss + (weights[:, 1:] ** 2).sum() / (2 * self.c), slope

    def direction(self) -> np.ndarray:
        q, kept = self.slope.copy(), []
        for s, y in reversed(self.past):
            a = (s * q).sum() / (s * y).sum()
            kept.append(a)
            q -= a * y
        r = q @ self.inverse
        for (s, y), a in zip(self.past, reversed(kept), strict=True):
            r += s * (a - (y * r).sum() / (s * y).sum())
        return -r

    def look(self, value: float, slope: np.ndarray) -> None:
        """Takes what the trial point gave; sets the next trial point or is done."""
        if self.slope is not None:
            moved, before = self.trial - self.weights, (self.slope * (self.trial - self.weights)).sum()
            if not value <= self.value + 1e-4 * before + 1e-12 * abs(self.value):
                self.step /= 2
                self.past = [] if self.step < 1e-3 else self.past
                self.done = self.step < 1e-12
                self.trial = self.weights + moved / 2
                return
            bend = slope - self.slope
            if (moved * bend).sum() > 1e-12 * np.sqrt((moved**2).sum() * (bend**2).sum()):
                self.past = [*self.past[1 - MEMORY :], (moved, bend)]
        self.weights, self.value, self.slope, self.step = self.trial, value, slope, 1.0
        self.done = np.abs(slope).max() / self.rows <= FLAT
        way = self.direction()
        if (way * slope).sum() >= 0:
            self.past, way = [], -(slope @ self.inverse)
        self.trial = self.weights + way


def _start(train: DataFrame, vector: str, fold: str, labels: int, grid: list[float], final: bool) -> list[Model]:
    per = probes.gram(train.withColumn("__none", F.lit(0.0)), vector, "__none", fold)
    whole, out = sum(per.values()), []
    for k in [*sorted(per), *([None] if final else [])]:
        m = whole - per[k] if k is not None else whole
        n, sums, second = m[0, 0], m[0, 1:-1], m[1:-1, 1:-1]
        if n <= 0:
            raise ValueError("a fold has no training rows")
        mean = sums / n
        var = np.maximum(np.diag(second) / n - mean**2, 0)
        scale = np.where(var > 1e-24, np.sqrt(var), 1.0)
        gram = np.zeros((len(mean) + 1,) * 2)
        gram[0, 0], gram[1:, 1:] = n, (second - n * np.outer(mean, mean)) / np.outer(scale, scale)
        for c in grid:
            bound = gram / 2 + np.diag([0.0, *[1 / c] * len(mean)])
            zero = np.zeros((labels, len(mean) + 1))
            out.append(Model(k, c, mean, scale, n, np.linalg.inv(bound + 1e-9 * n * np.eye(len(bound))), zero, trial=zero))
    return out


def _sums(train: DataFrame, vector: str, label: str, fold: str, labels: list, at: list[tuple[int | None, np.ndarray]]) -> list[tuple[float, np.ndarray]]:
    """Each model's summed loss and raw gradient over the rows outside its fold, in one job."""
    folds, weights = [k for k, _ in at], np.stack([w for _, w in at])
    models, classes, width = weights.shape
    shared = train.sparkSession.sparkContext.broadcast(weights.reshape(models * classes, width))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, met = shared.value, np.zeros((models, 1 + classes * width)), False
        for batch in batches:
            if not batch.num_rows:
                continue
            met = True
            x = np.column_stack([np.ones(batch.num_rows), batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(batch.num_rows, -1)])
            true, own = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            z = (x @ w.T).reshape(len(x), models, classes)
            z -= z.max(axis=2, keepdims=True)
            p = np.exp(z)
            norm = p.sum(axis=2)
            inside = np.stack([np.ones(len(x), bool) if k is None else own != k for k in folds], axis=1)
            loss = np.log(norm) - np.take_along_axis(z, np.broadcast_to(true[:, None, None], (len(x), models, 1)), axis=2)[:, :, 0]
            p /= norm[:, :, None]
            p[np.arange(len(x)), :, true] -= 1
            p *= inside[:, :, None]
            total[:, 0] += (loss * inside).sum(axis=0)
            total[:, 1:] += (p.reshape(len(x), -1).T @ x).reshape(models, -1)
        if met:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                one = np.frombuffer(x.as_buffer(), "f8")
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    code = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(labels) for x in (v, i)]), F.col(label))
    parts = train.select(vector, code.alias("c"), F.col(fold).cast("long").alias("f")).mapInArrow(part, "sums binary")
    few = parts.repartition(ADDERS).mapInArrow(add, "sums binary") if train.sparkSession.sparkContext.defaultParallelism > ADDERS else parts.coalesce(1).mapInArrow(add, "sums binary")
    got = sum(np.frombuffer(bytes(r.sums), "f8") for r in few.collect())
    return [(float(r[0]), r[1:].reshape(classes, width)) for r in got.reshape(models, -1)]


def fit_grid(train: DataFrame, vector: str, label: str, fold: str, grid: list[float], final: bool = True) -> tuple[list, list[Model]]:
    """(labels, a model for each fold and C, and with `final` for all rows and each C): C times the loss plus half the squared weights.

    Constants aren't penalized; features are standardized by each model's training rows (population std, 0 as 1). Labels
    are those of all rows in order. Rows without a label, a vector or a fold raise.
    """
    known = train.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & F.col(fold).isNotNull())
    counts = train.agg(F.count("*").alias("n"), F.count_if(F.col(label).isNotNull() & F.col(vector).isNotNull() & F.col(fold).isNotNull()).alias("known")).first()
    if counts.n != counts.known or not counts.n:
        raise ValueError(f"{counts.n} rows, {counts.known} with a label, a vector and a fold")
    labels = [r[0] for r in known.select(label).distinct().orderBy(label).collect()]
    models = _start(known, vector, fold, len(labels), grid, final)
    for _ in range(STEPS):
        moving = [m for m in models if not m.done]
        if not moving:
            break
        found = _sums(known, vector, label, fold, labels, [(m.fold, m.raw(m.trial)) for m in moving])
        for m, (loss, gradient) in zip(moving, found, strict=True):
            m.look(*m.penalized(loss, gradient, m.trial))
    return labels, models


def predictions(rows: DataFrame, vector: str, keep: list[str], labels: list, models: list[Model], name: str = "said") -> DataFrame:
    """The kept columns and `name`, the place in `labels` that each model gives a row, in one matrix product a batch."""
    weights = np.stack([m.raw(m.weights) for m in models])
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            n = batch.num_rows
            x = np.column_stack([np.ones(n), batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(n, -1)]) if n else np.empty((0, w.shape[2]))
            said = np.einsum("nd,mkd->nmk", x, w, optimize=True).argmax(axis=2) if n else np.empty((0, len(w)), "i8")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(w), pa.int32()), pa.array(said.ravel().astype("i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], [*keep, name])

    return rows.select(*keep, vector).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"{name} array<int>"]))


def accuracies(train: DataFrame, vector: str, label: str, fold: str, grid: list[float]) -> DataFrame:
    """fold, c, n, accuracy of each held-out fold for each C: one pass scores all models."""
    labels, models = fit_grid(train, vector, label, fold, grid, final=False)
    held = [(k, m) for k, m in enumerate(models)]
    said = predictions(train, vector, [label, fold], labels, models)
    code = F.array(*[F.lit(x) for x in labels])
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(m.fold).cast("long").alias("fold"), F.lit(float(m.c)).alias("c"), F.get("said", F.lit(k)).alias("said")) for k, m in held]), lambda x: x["fold"] == F.col(fold))).alias("x")
    rows = said.select(label, each).select(F.col("x.fold").alias("fold"), "x.c", (F.get(code, F.col("x.said")) == F.col(label)).cast("double").alias("hit"))
    return rows.groupBy("fold", "c").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"))


def select_c(train: DataFrame, vector: str, label: str, fold: str, grid: list[float]) -> float:
    """Highest mean over folds of the accuracy, ties to the smaller C."""
    means = accuracies(train, vector, label, fold, grid).groupBy("c").agg(F.round(F.avg("accuracy"), 12).alias("a"))
    return means.orderBy(F.desc("a"), "c").first().c
