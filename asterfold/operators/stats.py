"""Summaries, error metrics, classification reports, bootstraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterfold.functions import hashing
from asterfold.functions.binding import bound
from asterfold.operators import order

#: Rows that a task groups by their key.
TASK_ROWS = 100_000


def r6(c: Column) -> Column:
    return F.round(c, 6) + 0.0


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, population std, min, max per group."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), r6(F.avg(v)).alias("mean"), r6(F.stddev_pop(v)).alias("std"), r6(F.min(v)).alias("min"), r6(F.max(v)).alias("max"))


def residual(predicted: Column, true: Column) -> Column:
    return (predicted - true) / (1 + true)


def regression(df: DataFrame, by: list[str], predicted: str, true: str, threshold: float) -> DataFrame:
    """MAE, R2 (null without variance), share of residuals strictly beyond the threshold."""
    p, t = F.col(predicted).cast("double"), F.col(true).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), r6(F.avg(F.abs(p - t))).alias("mae"),
        r6(1 - F.try_divide(F.sum((p - t) * (p - t)), F.count("*") * F.var_pop(t))).alias("r2"),
        r6(F.avg((F.abs(residual(p, t)) > threshold).cast("double"))).alias("outlier_fraction"),
    )


def nmad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """1.4826 times the median distance from the median; exact medians, no group in one task."""
    middle = order.quantiles(df, by, value, [0.5]).select(*by, F.col("value").alias("__m"))
    joined = df.join(order.small(middle), by) if by else df.crossJoin(middle)
    apart = order.quantiles(joined.select(*by, F.abs(F.col(value) - F.col("__m")).alias("__d")), by, "__d", [0.5])
    return apart.select(*by, r6(1.4826 * F.col("value")).alias("nmad"))


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """Exact linear quantiles, one row each."""
    found = order.quantiles(df, by, value, at)
    return found.select(*by, F.get(F.array(*[F.lit(p) for p in at]), F.col("k")).alias("quantile"), r6(F.col("value")).alias("value"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width counts between the least and the largest value; the last bin holds its right edge."""
    edges = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    spread = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"), F.lit(bins - 1)))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(spread.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def report(df: DataFrame, predicted: str, true: str) -> DataFrame:
    """Precision, recall, F1 and support per label, 0 where undefined; no join: each row counts for its two labels."""
    p, t = F.col(predicted), F.col(true)
    sides = F.explode(F.when(p == t, F.array(F.struct(p.alias("label"), F.lit(1).alias("hit"), F.lit(1).alias("said"), F.lit(1).alias("is")))).otherwise(F.array(
        F.struct(p.alias("label"), F.lit(0).alias("hit"), F.lit(1).alias("said"), F.lit(0).alias("is")), F.struct(t.alias("label"), F.lit(0).alias("hit"), F.lit(0).alias("said"), F.lit(1).alias("is")))))
    c = df.select(sides.alias("s")).groupBy("s.label").agg(F.sum("s.hit").alias("tp"), F.sum("s.said").alias("said"), F.sum("s.is").alias("support"))
    precision, recall = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return c.select("label", r6(precision).alias("precision"), r6(recall).alias("recall"), r6(f1).alias("f1"), "support")


def class_seed_metrics(df: DataFrame, by: list[str], seed: str, predicted: str, true: str) -> DataFrame:
    """Mean and population std over the seeds of accuracy and macro-F1, and per_class: precision, recall, F1 and support by label of the first seed.

    Per_class is a sorted array of structs, of all labels said or true in that seed; no seed's rows meet in one task.
    """
    per = classification_summary(df, [*by, seed], predicted, true)
    out = [f for m in ("accuracy", "macro_f1") for f in (r6(F.avg(m)).alias(f"{m}_mean"), r6(F.stddev_pop(m)).alias(f"{m}_std"))]
    whole = per.groupBy(*by).agg(F.count("*").alias("seeds"), F.min(seed).alias("__first"), *out)
    p, t = F.col(predicted), F.col(true)
    sides = F.explode(F.array(F.struct(p.alias("label"), F.lit(1).alias("said"), F.lit(0).alias("is")), F.struct(t.alias("label"), F.lit(0).alias("said"), F.lit(1).alias("is"))))
    labels = df.select(*by, F.col(seed).alias("__first"), (p == t).cast("int").alias("hit"), sides.alias("s")).groupBy(*by, "__first", "s.label").agg(
        F.sum(F.col("hit") * F.col("s.is")).alias("tp"), F.sum("s.said").alias("said"), F.sum("s.is").alias("support"))
    share = lambda a, b: r6(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    row = F.struct("label", share(F.col("tp"), F.col("said")).alias("precision"), share(F.col("tp"), F.col("support")).alias("recall"), share(2.0 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support")
    first = labels.join(whole.select(*by, "__first"), [*by, "__first"], "left_semi").groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("per_class"))
    return whole.drop("__first").join(first, by)


def classification_summary(df: DataFrame, by: list[str], predicted: str, true: str) -> DataFrame:
    """n, accuracy and macro-F1, the mean F1 of all labels that are said or true, 0 where undefined."""
    p, t = F.col(predicted), F.col(true)
    sides = F.explode(F.array(F.struct(p.alias("label"), F.lit(1).alias("said"), F.lit(0).alias("is")), F.struct(t.alias("label"), F.lit(0).alias("said"), F.lit(1).alias("is"))))
    labels = df.select(*by, (p == t).cast("int").alias("hit"), sides.alias("s")).groupBy(*by, "s.label").agg(
        F.sum(F.col("hit") * F.col("s.is")).alias("tp"), F.sum("s.said").alias("said"), F.sum("s.is").alias("support"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("said") + F.col("support")), F.lit(0.0))
    return labels.groupBy(*by).agg(F.sum("support").alias("n"), r6(F.sum("tp") / F.sum("support")).alias("accuracy"), r6(F.avg(f1)).alias("macro_f1"))


def all_passed(df: DataFrame, by: list[str], passed: Column) -> DataFrame:
    """Rows, rows that pass, and whether all do, per group."""
    ok = F.coalesce(passed, F.lit(False))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_passed"), F.bool_and(ok).alias("all_passed"))


def majority(df: DataFrame, by: list[str], label: str) -> DataFrame:
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.max_by(label, F.struct("n", (-F.col(label)).alias("x"))).alias("majority"))


def bootstrap(objects: DataFrame, key: str, total: str, weight: str, samples: int, seed: int, confidence: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """Percentile interval of sum(total) / sum(weight) over resampled objects, for few thousand objects or many.

    A resample gives each object a Poisson(1) count drawn from the hash of (object, resample): draws are independent
    of partitioning, need no positions and no shuffle of pairs, only partial sums per resample.
    """
    by = by or []
    drawn = poisson_draws(objects, key, samples, seed)
    means = drawn.groupBy(*by, "resample").agg(F.try_divide(F.sum(F.col("c") * F.col(total)), F.sum(F.col("c") * F.col(weight))).alias("m"))
    tail = (1 - confidence) / 2
    out = means.groupBy(*by).agg(r6(F.percentile("m", F.lit(tail))).alias("ci_low"), r6(F.percentile("m", F.lit(1 - tail))).alias("ci_high"))
    point = objects.groupBy(*by).agg(r6(F.sum(total) / F.sum(weight)).alias("estimate"), F.count("*").alias("objects"))
    return out.join(point, by) if by else out.crossJoin(point)


def poisson_draws(objects: DataFrame, key: str, samples: int, seed: int) -> DataFrame:
    """objects once for each resample, with c, its Poisson(1) count from the hash of (object, resample)."""
    digits = F.substring(F.sha2(hashing.joined(F.col(key), F.col("resample"), f"bootstrap-{seed}"), 256), 1, 16)
    mass = cumulative = 0.36787944117144233
    ends = [cumulative]
    for k in range(1, 8):
        mass /= k
        cumulative += mass
        ends.append(cumulative)
    # the least digits whose fraction reaches an end: digits of one length compare as their numbers do, without a conversion a draw
    least = [F.lit(f"{reaching(e):016x}") for e in ends]
    rows = objects.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("resample"))
    return rows.withColumn("c", bound(digits, lambda d: sum((F.when(d >= x, 1).otherwise(0) for x in least[1:]), F.when(d >= least[0], 1).otherwise(0))))


def reaching(fraction: float) -> int:
    """The least 64-bit number that, as a double over 2^64, is at least the fraction."""
    low, high = 0, 2**64 - 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if float(middle) / 2.0**64 >= fraction else (middle + 1, high)
    return low


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df in tasks by key, as many as its rows need: a file of few bytes may hold many rows, and one task would group them all."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(tasks, key)


def shared_bootstrap(objects: DataFrame, key: str, contrasts: list[str], samples: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """contrast, estimate, ci_low, ci_high, objects of the mean of each column, all from the same resamples.

    An object counts for a contrast where that isn't null. One draw an object and resample serves all columns, so
    intervals may be compared with each other.
    """
    drawn = poisson_draws(objects, key, samples, seed)
    mean = lambda c, w: F.try_divide(F.sum(w * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), w)))
    means = drawn.groupBy("resample").agg(*[mean(c, F.col("c")).alias(c) for c in contrasts])
    tail = (1 - confidence) / 2
    ends = means.agg(*[F.percentile(c, F.array(F.lit(tail), F.lit(1 - tail))).alias(c) for c in contrasts])
    point = objects.agg(*[F.struct(F.avg(c).alias("estimate"), F.count(c).alias("objects")).alias(f"p_{k}") for k, c in enumerate(contrasts)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("contrast"), F.col(c).alias("ends"), F.col(f"p_{k}").alias("point")) for k, c in enumerate(contrasts)])).alias("x")
    rows = ends.crossJoin(point).select(each)
    return rows.select("x.contrast", r6(F.col("x.point.estimate")).alias("estimate"), r6(F.col("x.ends")[0]).alias("ci_low"), r6(F.col("x.ends")[1]).alias("ci_high"), F.col("x.point.objects").alias("objects"))


def paired_contrasts(df: DataFrame, key: str, seed: str, encoder: str, family: str, base: str, other: str, families: list[str], predicted: str, true: str, samples: int, draw: int) -> DataFrame:
    """By how much `other` errs less than `base`, for each probe family and on both scales, with a decision; shared draws.

    Errors are absolute or over 1 + true. An object's difference is its mean over the seeds in which a family has both.
    """
    error = F.abs(F.col(predicted) - F.col(true))
    side = lambda e, c: F.avg(F.when(F.col(encoder) == c, e))
    scaled = {"absolute": error, "one_plus_z": error / (1 + F.col(true))}
    per = dealt(df.where(F.col(family).isin(families)), key).groupBy(key, seed, family).agg(*[(side(e, base) - side(e, other)).alias(f"__{s}") for s, e in scaled.items()])
    names = {f"{f}_{s}": F.avg(F.when(F.col(family) == f, F.col(f"__{s}"))) for f in families for s in scaled}
    objects = per.groupBy(key).agg(*[c.alias(n) for n, c in names.items()])
    return shared_bootstrap(objects, key, list(names), samples, draw).withColumn("decision", decision(F.col("ci_low"), F.col("ci_high")))


def decision(ci_low: Column, ci_high: Column) -> Column:
    return F.when(ci_low > 0, "improves").when(ci_high < 0, "worsens").otherwise("undecided")


def collapse_check(df: DataFrame, vector: str, least_std: float = 1e-4, most_similarity: float = 0.99) -> DataFrame:
    """Mean feature std and mean off-diagonal similarity, from sums only: (|sum x|^2 - sum |x|^2) / (n (n - 1))."""
    dims = df.select(F.posexplode(vector).alias("d", "x")).withColumn("x", F.col("x").cast("double")).groupBy("d").agg(F.stddev_pop("x").alias("s"), F.sum("x").alias("t"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    out = dims.agg(F.avg("s").alias("std"), F.try_divide(F.sum(F.col("t") * F.col("t")) - F.sum("q"), F.max("n") * (F.max("n") - 1)).alias("similarity"))
    return out.select(r6(F.col("std")).alias("mean_std"), r6(F.col("similarity")).alias("mean_similarity"), ((F.col("std") > least_std) & (F.col("similarity") < most_similarity)).alias("noncollapsed"))


def seed_metrics(df: DataFrame, by: list[str], seed: str, predicted: str, true: str, threshold: float) -> DataFrame:
    """regression() per seed, then the mean and population std over the seeds of each metric."""
    per = regression(df, [*by, seed], predicted, true, threshold)
    out = [f(F.col(m)) for m in ("mae", "r2", "outlier_fraction") for f in (lambda c, m=m: r6(F.avg(c)).alias(f"{m}_mean"), lambda c, m=m: r6(F.stddev_pop(c)).alias(f"{m}_std"))]
    return per.groupBy(*by).agg(F.count("*").alias("seeds"), *out)


def pooled(reused: DataFrame, new: DataFrame, by: list[str], seed: str, value: str) -> DataFrame:
    """summary() over the seeds of both tables; a seed that both have counts once, as it is in `reused`."""
    fresh = new.join(reused.select(*by, seed), [*by, seed], "left_anti")
    return summary(reused.select(*by, seed, value).unionByName(fresh.select(*by, seed, value)), by, value)


def paired_errors(df: DataFrame, key: str, seed: str, condition: str, base: str, other: str, predicted: str, true: str, samples: int, draw: int) -> DataFrame:
    """By how much `other` errs less than `base` on the same objects, per scale, with an interval and a decision.

    Errors are absolute or over 1 + true. An object's difference is its mean over the seeds that have both conditions.
    """
    error = F.abs(F.col(predicted) - F.col(true))
    scaled = {"absolute": error, "one_plus_z": error / (1 + F.col(true))}
    side = lambda c, e: F.avg(F.when(F.col(condition) == c, e))
    per = df.groupBy(key, seed).agg(*[(side(base, e) - side(other, e)).alias(s) for s, e in scaled.items()])
    objects = per.groupBy(key).agg(*[F.avg(s).alias(s) for s in scaled])
    found = shared_bootstrap(objects, key, list(scaled), samples, draw).withColumnRenamed("contrast", "scale")
    return found.where("objects > 0").withColumn("decision", decision(F.col("ci_low"), F.col("ci_high")))


def passes_cap(df: DataFrame, by: list[str], along: str, value: str, cap: float) -> DataFrame:
    """Of each group the first row, along a column, at which the running total of value is above the cap."""
    over = order.running_sum(df, by, along, value, "running").where(F.col("running") > cap)
    return over.groupBy(*by).agg(F.min_by(F.struct(along, "running"), along).alias("first")).select(*by, f"first.{along}", "first.running")


def at_cap(df: DataFrame, by: list[str], cap: int) -> DataFrame:
    """Groups with `cap` rows or more: a k-nearest search may have cut their lists short."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= cap)


def grid_counts(df: DataFrame, dimensions: dict[str, list], count: str = "n") -> DataFrame:
    """Rows of every combination of the given values, empty ones too, as column `count`."""
    cells = df.sparkSession.range(1).drop("id")
    for name, values in dimensions.items():
        cells = cells.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    counted = df.groupBy(*dimensions).agg(F.count("*").alias(count))
    return cells.join(counted, list(dimensions), "left").fillna(0, [count])
