"""Deterministic splits, samples, folds and noise from SHA-256; never a session's random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asterfold.operators import order


def joined(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def fraction(*parts: Column | str) -> Column:
    """A stable number in [0, 1): the first 16 hex digits of the SHA-256 over 2^64."""
    digits = F.substring(F.sha2(joined(*parts), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def selection_key(salt: str, key: Column, seed: int) -> Column:
    return F.sha2(joined(salt, key, str(seed)), 256)


def split(key: Column, seed: int, train_ratio: float) -> Column:
    return F.when(fraction(key, str(seed)) < train_ratio, "train").otherwise("validation")


def sample(df: DataFrame, key: str, n: int, salt: str, seed: int) -> DataFrame:
    """n rows by hash order, ties by key: a distributed top-n, the same on any partitioning."""
    return df.withColumn("__k", selection_key(salt, F.col(key), seed)).orderBy("__k", key).limit(n).drop("__k")


def exact_sample(df: DataFrame, key: str, n: int, salt: str, seed: int, keep: Column | None = None) -> DataFrame:
    """The n rows of the smallest hashes among those that `keep` holds for, ties by key; fewer than n raise.

    Counts by the hash's first digits give the digits up to which all rows are in, counts by the next ones do so within the last
    of them, and only rows alike in eight digits are ranked: no order over all rows, and the driver sees 65,536 counts at most.
    """
    if n <= 0:
        raise ValueError("a sample needs a positive size")
    rows = df.where(F.coalesce(keep, F.lit(False))) if keep is not None else df
    rows = rows.withColumn("__k", selection_key(salt, F.col(key), seed))
    left, prefix = n, ""
    for _ in range(2):
        digits = F.substring("__k", len(prefix) + 1, 4)
        inside = rows.where(F.col("__k").startswith(prefix)) if prefix else rows
        counts = sorted((r.d, r.n) for r in inside.groupBy(digits.alias("d")).agg(F.count("*").alias("n")).collect())
        if not prefix and sum(c for _, c in counts) < n:
            raise ValueError(f"{sum(c for _, c in counts)} rows fit, {n} asked for")
        for d, c in counts:
            if c >= left:
                prefix += d
                break
            left -= c
    alike = F.substring("__k", 1, len(prefix))
    edge = rows.where(alike == prefix).withColumn("__r", F.row_number().over(Window.partitionBy(alike).orderBy("__k", key))).where(F.col("__r") <= left).drop("__r")
    return rows.where(alike < prefix).unionByName(edge).drop("__k")


def fold(key: Column, folds: int, seed: int) -> Column:
    """Fold of a key by its hash alone: no global order, so no single task."""
    return F.floor(fraction(key, f"fold-{seed}") * folds).cast("int")


def exact_folds(df: DataFrame, key: str, folds: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """Folds of sizes that differ by one at most within each `by` group: position in hash order modulo folds."""
    h = F.sha2(joined(F.col(key), f"fold-{seed}"), 256)
    rows = df.withColumn("__h", h) if by else df.withColumns({"__h": h, "__all": F.lit(0)})
    placed = order.ranked(rows, by or ["__all"], order.hex_bucket(F.col("__h")), [F.col("__h"), F.col(key)], "__k")
    return placed.withColumn("fold", ((F.col("__k") - 1) % folds).cast("int")).drop("__h", "__k", "__all")


def derangement(df: DataFrame, key: str, seed: int, by: list[str]) -> DataFrame:
    """(by, key, partner): the next key in hash order within the group, the last to the first; no fixed point from two keys on."""
    rows = df.select(*by, key, F.sha2(joined(F.col(key), f"derange-{seed}"), 256).alias("__h"))
    return order.following(rows, by, order.hex_bucket(F.col("__h")), [F.col("__h"), F.col(key)], key, "partner").drop("__h")
