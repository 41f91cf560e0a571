"""Values joined with a table of intervals: unequal, open at an end, overlapping or apart, of any number.

The intervals' own ends cut the axis into buckets. A value falls into one bucket, found by a tree of comparisons inside generated code; an
interval is repeated for the buckets that it meets; so the range join is an equi-join by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterfold.operators import order
from asterfold.sources.scratch import staged

#: Cuts of the axis, and intervals that are broadcast at most (repeated for the buckets that they meet, 256 each at worst).
CUTS, BROADCAST_BINS = 255, 5_000


def bucket_of(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts are at most the value: log2 of their number comparisons a row."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < cuts[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(cuts))


def cuts_of(bins: DataFrame, low: str, high: str) -> tuple[list[float], bool]:
    """At most CUTS of the intervals' ends, evenly by rank, and whether the intervals are few enough for a broadcast."""
    ends = bins.select(F.col(low).cast("double").alias("lo"), F.col(high).cast("double").alias("hi"))
    some = ends.limit(BROADCAST_BINS + 1).collect()
    if len(some) <= BROADCAST_BINS:
        every = sorted({x for r in some for x in r if x is not None and abs(x) < float("inf")})
        step = max(1, -(-len(every) // CUTS))
        return every[::step], True
    flat = ends.select(F.explode(F.array("lo", "hi")).alias("e")).where("e is not null and not isnan(e) and abs(e) < double('inf')")
    marks = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    return sorted(set(flat.distinct().approxQuantile("e", marks, 1 / (8 * CUTS)))), False


def assigned(rows: DataFrame, value: str, bins: DataFrame, low: str, high: str) -> DataFrame:
    """rows with the columns of each interval [low, high) that holds their value; a null end is open. Inner: others are left out.

    Null and NaN values lie in no interval. Column names of the sides must differ.
    """
    cuts, few = cuts_of(bins, low, high)
    lo, hi = F.col(low).cast("double"), F.col(high).cast("double")
    first = F.coalesce(bucket_of(lo, cuts), F.lit(0)) if cuts else F.lit(0)
    last = F.coalesce(bucket_of(hi, cuts), F.lit(len(cuts))) if cuts else F.lit(0)
    some = bins.where(F.coalesce(lo < hi, F.lit(True))).withColumn("__bucket", F.explode(F.sequence(F.when(lo.isNull(), 0).otherwise(first), F.when(hi.isNull(), len(cuts)).otherwise(last))))
    v = F.col(value).cast("double")
    placed = rows.where(v.isNotNull() & ~F.isnan(v)).withColumn("__own", bucket_of(v, cuts) if cuts else F.lit(0))
    inside = (F.col("__own") == F.col("__bucket")) & F.coalesce(v >= lo, F.lit(True)) & F.coalesce(v < hi, F.lit(True))
    return placed.join(F.broadcast(some) if few else some, inside).drop("__own", "__bucket")


def counted(rows: DataFrame, value: str, bins: DataFrame, low: str, high: str, by: list[str], **sums: Column) -> DataFrame:
    """Each interval with the named sums over its rows, 0 where it has none; by: the columns that tell intervals apart."""
    found = assigned(rows, value, bins.select(*dict.fromkeys([*by, low, high])), low, high).groupBy(*by).agg(*[F.sum(c.cast("long")).alias(n) for n, c in sums.items()])
    found = found.withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:  # an open end is null
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return bins.join(found, same, "left").drop(*[f"__{c}" for c in by]).fillna(0, list(sums))


def sizes(rows: DataFrame, value: str, bins: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """bins with the number of rows in each [low, high), as column `name`; a null end is open.

    The number of values below an end is a running total along values and ends together, so no value meets its intervals: the work
    grows with the rows of both, however many intervals hold a value.
    """
    v = F.col(value).cast("double")
    values = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy((v + 0.0).alias("at")).agg(F.count("*").alias("n"))
    lo, hi = (F.col(c).cast("double") + 0.0 for c in (low, high))
    ends = bins.select(F.explode(F.array(lo, hi)).alias("at")).where("at is not null").distinct()
    points = ends.select("at", F.lit(0).cast("long").alias("n"), F.lit(0).alias("kind")).unionByName(values.select("at", "n", F.lit(1).alias("kind")))
    along = points.select(F.lit(0).alias("all"), F.struct("at", "kind").alias("place"), "n")  # an end comes before its equal value
    below = staged(order.running_sum(along, ["all"], "place", "n", "below").where("place.kind = 0").select("place.at", "below"), "ends")
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__total"))
    side = lambda n: below.select(F.col("at").alias(f"__{n}"), F.col("below").alias(n))
    out = bins.withColumns({"__x": lo, "__y": hi}).join(side("__first"), F.col("__x") == F.col("____first"), "left").join(side("__last"), F.col("__y") == F.col("____last"), "left").crossJoin(F.broadcast(total))
    n = F.when(F.col("__y").isNull(), F.col("__total")).otherwise(F.col("__last")) - F.when(F.col("__x").isNull(), 0).otherwise(F.col("__first"))
    return out.withColumn(name, F.greatest(n, F.lit(0).cast("long"))).select(*bins.columns, name)
