"""Graded metrics of groups of any size in one pass: each task keeps a group's counts and its k best rows, and these merge.

A task's state is two short lists a group, the k best rows by score and the k largest grades, beside its counts. So a
group's rows are never gathered or sorted as a whole; the exchange carries 2 k rows a group and task at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a row of a task's state is.
BEST, GRADE, COUNTS = 0, 1, 2


def _groups(table: pa.Table, by: list[str]) -> np.ndarray:
    """A number for each row's group; null is a value like any other."""
    out = np.zeros(len(table), "i8")
    for c in by:
        coded = pc.dictionary_encode(table.column(c).combine_chunks(), null_encoding="encode")
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        out = out * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        out = np.unique(out, return_inverse=True)[1]
    return out


def _first(table: pa.Table, by: list[str], order: list[tuple[str, str]], k: int) -> pa.Table:
    """The k first rows of each group along the order, nulls last."""
    if not len(table):
        return table
    numbered = table.append_column("__g", pa.array(_groups(table, by)))
    at = pc.sort_indices(numbered, sort_keys=[("__g", "ascending"), *order])
    group = numbered.column("__g").take(at).to_numpy()
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    place = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
    return table.take(at.filter(pa.array(place < k)))


def top_states(rows: DataFrame, by: list[str], tie: str, score: str, graded: str, binary: str, k: int, extra: list[str]) -> DataFrame:
    """by, kind, n, positives, score, tie, graded, binary and the extra columns: every task's state of its groups."""
    names = [*by, score, tie, graded, binary, *extra]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    selected = rows.select(*by, F.col(score).cast("double").alias(score), tie, F.col(graded).cast("double").alias(graded), F.coalesce(F.col(binary).cast("boolean"), F.lit(False)).alias(binary), *[F.col(c).cast("double").alias(c) for c in extra])
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "kind int, n long, positives long", f"score double, tie {kinds[tie]}, graded double, binary boolean", *(f"`{c}` double" for c in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = grades = counts = None
        for batch in batches:
            if not batch.num_rows:
                continue
            some = pa.Table.from_batches([batch]).rename_columns(names)
            own = some.select(by).append_column("n", pa.array(np.ones(len(some), "i8"))).append_column("positives", some.column(binary).cast(pa.int64()))
            grade = some.select([*by, graded])
            if best is not None:
                some, grade, own = pa.concat_tables([best, some]), pa.concat_tables([grades, grade]), pa.concat_tables([counts, own])
            best = _first(some, by, [(score, "descending"), (tie, "ascending")], k).combine_chunks()
            grades = _first(grade, by, [(graded, "descending")], k).combine_chunks()
            counts = own.group_by(by).aggregate([("n", "sum"), ("positives", "sum")]) if by else own.group_by([]).aggregate([("n", "sum"), ("positives", "sum")])
            counts = counts.rename_columns({"n_sum": "n", "positives_sum": "positives"}).select([*by, "n", "positives"])
        if best is None:
            return
        kind = lambda t, value: pa.array(np.full(len(t), value, "i4"))
        none = lambda t, like: pa.nulls(len(t), like)
        f8, i8, b = pa.float64(), pa.int64(), pa.bool_()
        tie_type = best.schema.field(tie).type
        columns = [*by, "kind", "n", "positives", "score", "tie", "graded", "binary", *extra]
        parts = [
            [*best.select(by).columns, kind(best, BEST), none(best, i8), none(best, i8), *best.select([score, tie, graded, binary, *extra]).columns],
            [*grades.select(by).columns, kind(grades, GRADE), none(grades, i8), none(grades, i8), none(grades, f8), none(grades, tie_type), grades.column(graded), none(grades, b), *[none(grades, f8) for _ in extra]],
            [*counts.select(by).columns, kind(counts, COUNTS), counts.column("n"), counts.column("positives"), none(counts, f8), none(counts, tie_type), none(counts, f8), none(counts, b), *[none(counts, f8) for _ in extra]],
        ]
        for part in parts:
            yield from pa.table(part, names=columns).combine_chunks().to_batches(max_chunksize=10_000)

    return selected.mapInArrow(run, schema)


def gains(grades: Column) -> Column:
    """Discounted gain of grades in order."""
    each = F.transform(grades, lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + F.lit(2.0)))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def merged(states: DataFrame, by: list[str], k: int, extra: list[str]) -> DataFrame:
    """by, n, positives, head (the k best rows of a group in order) and ideal (its k largest grades) of the tasks' states."""
    row = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("less"), "tie", "graded", "binary", *extra)
    listed = states.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("positives").alias("positives"), F.array_sort(F.collect_list(F.when(F.col("kind") == BEST, row))).alias("head"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == GRADE, F.col("graded"))), asc=False).alias("ideal"))
    return listed.withColumns({"head": F.slice("head", 1, k), "ideal": F.slice("ideal", 1, k)})


def group_metrics(rows: DataFrame, by: list[str], tie: str, graded: str, binary: str, k: int, means: dict[str, Column] | None = None, score: str = "score") -> DataFrame:
    """nDCG, recall, its ceiling min(k, P) / P, and precision hits / min(k, n) per group; null recall without positives.

    The ideal order is that of all the group's rows; nDCG is 0 without a positive grade. means: columns whose mean over
    the k best rows is wanted. Rows without a score come last; ties go by `tie`.
    """
    means = means or {}
    extra = [f"__m{i}" for i in range(len(means))]
    named = rows.withColumns(dict(zip(extra, means.values(), strict=True))) if means else rows
    found = merged(top_states(named, by, tie, score, graded, binary, k, extra), by, k, extra)
    p, hits = F.col("positives").cast("double"), F.size(F.filter("head", lambda x: x["binary"]))
    mean = lambda c: F.get(F.transform(F.array(F.filter("head", lambda x: x[c].isNotNull())), lambda kept: F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x[c]), F.size(kept))), F.lit(0))
    ndcg = F.coalesce(F.try_divide(gains(F.transform("head", lambda x: x["graded"])), gains(F.col("ideal"))), F.lit(0.0))
    return found.select(
        *by, "n", "positives", F.round(F.try_divide(hits.cast("double"), p), 6).alias("recall"), F.round(F.try_divide(F.least(F.lit(float(k)), p), p), 6).alias("recall_ceiling"),
        F.round(hits / F.least(F.lit(k), F.col("n")), 6).alias("precision"), *[(F.round(mean(c), 6) + 0.0).alias(name) for c, name in zip(extra, means, strict=True)],
        (F.round(ndcg, 6) + 0.0).alias(f"ndcg_at_{k}"))


def ndcg(scored: DataFrame, by: list[str], tie: str, relevance: str, k: int) -> DataFrame:
    """nDCG@k per group alone."""
    whole = scored.withColumn("__hit", F.col(relevance) > 0)
    return group_metrics(whole, by, tie, relevance, "__hit", k).select(*by, f"ndcg_at_{k}")
