"""Catalogs laid out in sky cells of several orders: which leaf holds a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterfold.functions import sky
from asterfold.operators import validation

#: Leaves of one order that are broadcast at most; more are joined by a shuffle.
BROADCAST_LEAVES = 200_000


def assign_leaves(points: DataFrame, leaves: DataFrame, ra: str, dec: str) -> DataFrame:
    """points with cell_order and cell_pixel of the leaf (cell_order, cell_pixel) that holds them, the finest of several.

    One equi-join per order that occurs (30 at most); a place outside all leaves raises.
    """
    sizes = {r.cell_order: r.n for r in leaves.groupBy("cell_order").agg(F.count("*").alias("n")).collect()}
    out, found = points, []
    for order in sorted(sizes, reverse=True):
        mine = leaves.where(F.col("cell_order") == order).select(F.col("cell_pixel").alias(f"__p{order}")).distinct()
        mine = mine.withColumn(f"__in{order}", F.lit(True))
        out = out.withColumn(f"__p{order}", sky.nested_pixel(F.col(ra), F.col(dec), order)).join(F.broadcast(mine) if sizes[order] <= BROADCAST_LEAVES else mine, f"__p{order}", "left")
        found.append(order)
    pick = lambda value: F.coalesce(*[F.when(F.col(f"__in{k}"), value(k)) for k in found]) if found else F.lit(None).cast("long")
    out = out.select(*points.columns, pick(lambda k: F.lit(k)).cast("int").alias("cell_order"), pick(lambda k: F.col(f"__p{k}")).alias("cell_pixel"))
    return validation.require(out, {"outside all leaves": F.col("cell_order").isNull()})


def adaptive_leaves(points: DataFrame, ra: Column, dec: Column, coarse: int, fine: int, most: int) -> DataFrame:
    """Leaves for a catalog: the coarse pixels that hold places, those with more than `most` split into their fine ones."""
    at = points.select(sky.nested_pixel(ra, dec, fine).alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    at = at.withColumn("c", F.shiftright("f", 2 * (fine - coarse)))
    whole = at.groupBy("c").agg(F.sum("n").alias("total"))
    split = at.join(whole.where(F.col("total") > most).select("c"), "c", "left_semi").select(F.lit(fine).alias("cell_order"), F.col("f").alias("cell_pixel"))
    return whole.where(F.col("total") <= most).select(F.lit(coarse).alias("cell_order"), F.col("c").alias("cell_pixel")).unionByName(split)
