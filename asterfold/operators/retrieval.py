"""Ranking and graded metrics over long (query, candidate) rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterfold.operators import validation
from asterfold.operators.toplists import group_metrics, ndcg  # noqa: F401  metrics of whole groups

#: Query vectors that one broadcast holds (25 MB at 64 dimensions), and those that a task multiplies at once.
QUERY_BLOCK, CHUNK = 50_000, 100
#: Scores that differ by less may be one rounded score, so rows so near the k-th best are kept, too.
NEAR = 2e-6


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)


def top_scores(queries: DataFrame, candidates: DataFrame, query_id: str, query_vector: str, key: str, vector: str, k: int, keep: list[str], by: str | None = None) -> DataFrame:
    """For each query the k best candidates by dot product, ties by key: query_id, key, `keep`, score (6 digits), rank.

    A query is not its own candidate. With `by`, k of each value of that candidate column. The stated queries are
    broadcast in blocks; each Arrow batch of candidates is scored by one matrix product per chunk of queries, and only
    rows that may be among the k best leave a task, so no pair is shuffled otherwise. Both keys are longs.
    """
    spark = candidates.sparkSession
    if candidates.select(F.spark_partition_id().alias("p")).distinct().count() < spark.sparkContext.defaultParallelism:
        candidates = candidates.repartition(spark.sparkContext.defaultParallelism)  # one small file: deal it to all cores
    columns = [key, *dict.fromkeys([*keep, *([by] if by else [])])]
    rows = candidates.select(*columns, vector)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"{query_id} long", *(f"{c} {kinds[c]}" for c in columns), "score double"])
    n = queries.count()
    blocks, out = max(1, -(-n // QUERY_BLOCK)), None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == block).select(F.col(query_id).cast("long"), query_vector).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        shared = spark.sparkContext.broadcast((own.column(0).to_numpy(), matrix(own.column(1).combine_chunks())))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, wanted = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, values = batch.column(0).to_numpy(), matrix(batch.column(len(columns)))
                groups = batch.column(columns.index(by)).to_numpy(zero_copy_only=False) if by else np.zeros(len(keys), "i8")
                for low in range(0, len(ids), CHUNK):
                    dots = wanted[low : low + CHUNK] @ values.T
                    dots[ids[low : low + CHUNK, None] == keys[None, :]] = -np.inf
                    for g in np.unique(groups):
                        at = np.flatnonzero(groups == g)
                        part = dots[:, at]
                        least = np.partition(part, -k, axis=1)[:, -k] if len(at) > k else np.full(len(part), -np.inf)
                        q, c = np.nonzero((part >= least[:, None] - NEAR) & (part > -np.inf))
                        some = batch.select(columns).take(pa.array(at[c]))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[low + q]), *some.columns, pa.array(part[q, c])], [query_id, *columns, "score"])

        part = rows.mapInArrow(score, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return top(out.withColumn("score", F.round("score", 6) + 0.0), [query_id, *([by] if by else [])], key, k)


def ranked(scored: DataFrame, by: list[str], tie: str, name: str = "rank", score: str = "score") -> DataFrame:
    """1..n within `by` by score descending, ties by `tie`."""
    return scored.withColumn(name, F.expr(f"cast(row_number() over (partition by {', '.join(by)} order by {score} desc, {tie}) as int)"))


def top(scored: DataFrame, by: list[str], tie: str, k: int) -> DataFrame:
    return ranked(scored, by, tie).where(F.col("rank") <= k)


def gain(relevance: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1)


def top_ndcg(head: DataFrame, positives: DataFrame, by: list[str], relevant: str, k: int) -> DataFrame:
    """nDCG@k of 0/1 relevance from the k best rows alone: the ideal order follows from a group's count of positives.

    positives: (by, positives); a group that it lacks has none.
    """
    gains = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda s, i: s + F.when(i <= F.col("positives"), 1 / F.log2(i + 1)).otherwise(0.0))
    got = head.where(F.col("rank") <= k).groupBy(*by).agg(F.sum(gain(F.col(relevant), F.col("rank"))).alias("dcg"))
    value = F.coalesce(F.try_divide(F.col("dcg"), gains), F.lit(0.0))
    return got.join(positives, by, "left").fillna(0, ["positives"]).select(*by, (F.round(value, 6) + 0.0).alias(f"ndcg_at_{k}"))


def fold_summary(per_fold: DataFrame, by: list[str], fold: str, value: str, folds: int = 10) -> DataFrame:
    """Mean and population std of a metric over the folds; a group without exactly `folds` of them raises when it is read."""
    out = per_fold.groupBy(*by).agg(F.count_distinct(fold).alias("folds"), (F.round(F.avg(value), 6) + 0.0).alias("mean"), (F.round(F.stddev_pop(value), 6) + 0.0).alias("std"))
    whole = F.when(F.col("folds") == folds, F.col("folds")).otherwise(F.raise_error(F.concat(F.lit(f"{folds} folds expected, found "), F.col("folds").cast("string"))))
    return out.withColumn("folds", whole)


def recall(scored: DataFrame, by: list[str], tie: str, relevant: str, ks: list[int]) -> DataFrame:
    """Share of groups with a relevant candidate in the first k; the max(ks) best rows of a group suffice."""
    head = top(scored, by, tie, max(ks)).groupBy(*by).agg(F.min(F.when(F.col(relevant), F.col("rank"))).alias("first"))
    return head.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "first").groupBy("k").agg(F.round(F.avg((F.coalesce("first", F.lit(1 << 30)) <= F.col("k")).cast("double")), 6).alias("recall"))


def populations(rows: DataFrame, reason: str) -> DataFrame:
    """rows once for each population that they belong to: all of them, the anchors, the priority rows."""
    r = F.col(reason)
    tags = F.array(F.lit("enriched_all"), F.when(r.startswith("anchor_"), "anchor"), F.when(r == "morphology_priority", "morphology_priority"))
    return rows.withColumn("candidate_population", F.explode(F.array_compact(tags)))


def over_seeds(metrics: DataFrame, by: list[str], seed: str, measures: list[str]) -> DataFrame:
    """Mean and population std of each measure over the seeds, null values apart; the least count of positives."""
    out = [f for m in measures for f in ((F.round(F.avg(m), 6) + 0.0).alias(f"{m}_mean"), (F.round(F.stddev_pop(m), 6) + 0.0).alias(f"{m}_split_std"))]
    return metrics.groupBy(*by).agg(F.count_distinct(seed).alias("split_seeds"), F.min("positives").alias("relevant_objects_min"), *out)


def fusion_differences(metrics: DataFrame, by: list[str], condition: str, fusion: str, baselines: list[str], measures: list[str]) -> DataFrame:
    """The fusion condition's measures less each baseline's within a group, one row a baseline that has one; no join."""
    per = metrics.where(F.col(condition).isin(fusion, *baselines)).groupBy(*by).agg(
        F.any_value(F.when(F.col(condition) == fusion, F.struct(*measures)), True).alias("__f"),
        *[F.any_value(F.when(F.col(condition) == b, F.struct(*measures)), True).alias(f"__{k}") for k, b in enumerate(baselines)])
    each = F.explode(F.array(*[F.struct(F.lit(f"{fusion}_minus_{b}").alias("comparison"), F.col(f"__{k}").alias("b")) for k, b in enumerate(baselines)])).alias("c")
    rows = per.where("__f is not null").select(*by, "__f", each).where("c.b is not null")
    return rows.select(*by, "c.comparison", *[(F.round(F.col(f"__f.{m}") - F.col(f"c.b.{m}"), 6) + 0.0).alias(f"{m}_difference") for m in measures])


def vote(neighbours: DataFrame, by: list[str], label: str) -> DataFrame:
    """Most frequent label, ties by the smallest."""
    counts = neighbours.groupBy(*by, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.max(F.struct("n", (-F.col(label)).alias("m"))).alias("b"))
    return best.select(*by, (-F.col("b.m")).alias("prediction"))


def assembled(wanted: DataFrame, base: DataFrame, new: DataFrame, key: str, vector: str) -> DataFrame:
    """The vectors of the wanted keys from two caches that share no key; a wanted key without a vector raises."""
    validation.no_overlap(base, new, key)
    every = base.select(key, vector).unionByName(new.select(key, vector))
    return validation.require(wanted.join(every, key, "left"), {"no vector": F.col(vector).isNull()})


def query_targets(rows: DataFrame, queries: list[tuple[str, float, float, float]], value: Column, strength: Column) -> DataFrame:
    """rows repeated for each query (name, low, high, least strength) whose interval and strength they meet."""
    meets = F.filter(F.array(*[F.struct(F.lit(n).alias("query"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.lit(float(s)).alias("least")) for n, lo, hi, s in queries]),
                     lambda q: (value >= q["lo"]) & (value < q["hi"]) & (strength >= q["least"]))
    return rows.select("*", F.explode(F.transform(meets, lambda q: q["query"])).alias("query"))
