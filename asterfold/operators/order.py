"""Ranks, running totals and quantiles of groups that may hold a third of all rows: no group needs one task.

Rows fall into buckets along the order; a bucket's rows are ordered in one task, and what the buckets before it hold is
added as a prefix sum. Quantiles come from counts by magnitude and the exact values of the cells that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asterfold.sources.scratch import staged

#: Buckets along an order; groups times buckets that are gathered and broadcast at most (a few hundred bytes each).
BUCKETS, BROADCAST_CELLS = 256, 50_000
#: Cells of magnitude for each factor of e, and slices of a cell that are ordered apart.
STEPS, SLICES = 64, 1_024


def small(df: DataFrame) -> DataFrame:
    """df, written once, and broadcast if it has few rows; otherwise for Spark to join by shuffle."""
    return _few(df)


def hex_bucket(digits: Column) -> Column:
    """Bucket of an order by hex digits, which hashes fill evenly."""
    return F.conv(F.substring(digits, 1, 2), 16, 10).cast("int")


def laid_out(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df written once in ranges along (by, order), with __at, which grows along them, and __part, the range.

    A range is a task's, cut from a sample of the rows, so a group of any size is spread over many, and rows alike in
    one order column are told apart by the next. `by` holds no null.
    """
    keys = [*(F.col(c) for c in by), *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    rows = staged(ranges.withColumn("__at", F.monotonically_increasing_id()), "laid")
    return rows.withColumn("__part", F.shiftright("__at", 33).cast("int"))


def _few(cells: DataFrame) -> DataFrame:
    """cells, written once, and broadcast if they are few."""
    kept = staged(cells, "cells")
    return F.broadcast(kept) if kept.count() <= BROADCAST_CELLS else kept


def ranked_along(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """1..n within `by` along `order`, whose last column should tell all rows apart.

    No window and no group in one task: a row's rank is its place in its range and what the group has in earlier ones.
    """
    rows = laid_out(df, by, order)
    cells = rows.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__low"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = cells.select(*by, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__low") + 1).alias("__start"))
    return rows.join(_few(start), [*by, "__part"]).withColumn(name, (F.col("__at") + F.col("__start")).cast("int")).drop("__at", "__part", "__start")


def before(df: DataFrame, by: list[str], bucket: str, total: Column) -> DataFrame:
    """(by, bucket, before): the total of the group's buckets before each bucket."""
    cells = df.groupBy(*by, bucket).agg(total.alias("__t"))
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(*by, bucket, F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__before"))


def ranked(df: DataFrame, by: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """1..n within `by` along `order`, which the bucket must follow."""
    rows = df.withColumn("__bucket", bucket)
    own = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(*order))
    joined = rows.withColumn("__own", own).join(small(before(rows, by, "__bucket", F.count("*"))), [*by, "__bucket"])
    return joined.withColumn(name, (F.col("__own") + F.col("__before")).cast("int")).drop("__bucket", "__own", "__before")


def running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """The sum of value within `by` up to each row along the order column."""
    rows = laid_out(df, by, [F.col(order)])
    own = F.sum(value).over(Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    earlier = _few(before(rows, by, "__part", F.sum(value)))
    return rows.withColumn("__own", own).join(earlier, [*by, "__part"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__at", "__part", "__own", "__before")


def following(df: DataFrame, by: list[str], bucket: Column, order: list[Column], key: str, name: str) -> DataFrame:
    """The key of the next row of the group along `order`, for the last row that of the first."""
    rows = df.withColumn("__bucket", bucket)
    first = rows.groupBy(*by, "__bucket").agg(F.min_by(key, F.struct(*order)).alias("__first"))
    ring = Window.partitionBy(*by).orderBy("__bucket")
    whole = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring_next = first.select(*by, "__bucket", F.coalesce(F.lead("__first").over(ring), F.first("__first").over(whole)).alias("__next"))
    own = F.lead(key).over(Window.partitionBy(*by, "__bucket").orderBy(*order))
    return rows.withColumn("__own", own).join(small(ring_next), [*by, "__bucket"]).withColumn(name, F.coalesce("__own", "__next")).drop("__bucket", "__own", "__next")


def magnitude(v: Column) -> Column:
    """A cell of a double that never falls as the double grows: STEPS for each factor of e, alike on both sides of zero."""
    size = F.floor(F.ln(F.abs(v)) * STEPS) + 1_000 * STEPS
    return F.when(v > 0, size).when(v < 0, -size).when(v == 0, 0).otherwise(2_000 * STEPS)


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """by, k (place in `at`), value: exact linear quantiles of the values that aren't null.

    One scan counts values by magnitude, and prefix sums tell in which cells the wanted places lie. A second counts the
    equal values of those cells; they are ordered in slices of a cell, whose prefix sums give their places.
    """
    group = by or ["__all"]
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v is not null").withColumns({"__cell": magnitude(F.col("__v"))} | ({} if by else {"__all": F.lit(0)}))
    cells = rows.groupBy(*group, "__cell").agg(F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    whole = Window.partitionBy(*group)
    cells = cells.withColumns({"__n": F.sum("__c").over(whole), "__end": F.sum("__c").over(whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0))}).withColumn("__start", F.col("__end") - F.col("__c"))
    place = [F.lit(float(p)) * (F.col("__n") - 1) for p in at]
    inside = lambda x: (x >= F.col("__start")) & (x < F.col("__end"))
    asked = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), p.alias("place")) for k, p in enumerate(place)]), lambda x: inside(F.floor(x["place"])) | inside(F.ceil(x["place"])))
    wanted = small(cells.select(*group, "__cell", "__start", "__lo", "__hi", asked.alias("__asked")).where(F.size("__asked") > 0))
    met = rows.join(wanted.drop("__asked"), [*group, "__cell"])
    share = F.coalesce(F.try_divide(F.col("__v") - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    same = met.groupBy(*group, "__cell", "__start", F.least(F.floor(share * SLICES), F.lit(SLICES - 1)).cast("int").alias("__slice"), "__v").agg(F.count("*").alias("__c"))
    same = staged(same, "same")  # read twice: df is scanned for it once
    same = same.join(before(same, [*group, "__cell"], "__slice", F.sum("__c")), [*group, "__cell", "__slice"])
    own = F.sum("__c").over(Window.partitionBy(*group, "__cell", "__slice").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    placed = same.withColumn("__upto", F.col("__start") + F.col("__before") + own)
    each = placed.join(wanted.select(*group, "__cell", F.explode("__asked").alias("__x")), [*group, "__cell"]).select(*group, "__v", "__upto", "__x.k", "__x.place")
    reached = lambda x: F.min(F.when(F.col("__upto") > x, F.col("__v")))
    found = each.groupBy(*group, "k", "place").agg(reached(F.floor("place")).alias("__a"), reached(F.ceil("place")).alias("__z"))
    return found.select(*by, "k", (F.col("__a") + (F.col("__z") - F.col("__a")) * (F.col("place") - F.floor("place"))).alias("value"))
