"""The nearest place on the sphere at any distance, by going down a hierarchy of cells with distance bounds.

The sphere's box is cut into cells of half the edge at each level. A row starts at the box itself and goes down to
the cells that can still hold its nearest place: those no farther than the nearest place known so far, which is the one
that stands for one of the cells met. What is left at the last level is compared with the places themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asterfold.functions import sky
from asterfold.sources.scratch import staged

#: The finest level (cells of 0.8 arc seconds), levels that one step goes down, places that a last cell should hold at
#: most, cells of a level that are broadcast at most, and the chord that counts as nothing (2e-6 arc seconds).
FINEST, STEP, FULL, BROADCAST_CELLS, NOTHING = 19, 2, 64, 50_000, 1e-11
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Hierarchy:
    """places: each different place once (x, y, z, i, j, k, id: the smallest there). cells: the finest ones that hold
    places, with their number and one of them. level: where cells are small enough."""

    places: DataFrame
    cells: DataFrame
    n_cells: int
    level: int


def _packed(level: int) -> Column:
    """The cell of a level from the finest cell's numbers along the axes."""
    i, j, k = (F.shiftright(c, FINEST - level).cast("long") for c in ("i", "j", "k"))
    return F.shiftleft(i, 40).bitwiseOR(F.shiftleft(j, 20)).bitwiseOR(k)


def hierarchy(source: DataFrame, ra: str, dec: str, key: str) -> Hierarchy:
    """The source's places in cells, written once. Rows without a place are left out; no place at all raises."""
    x, y, z = sky.unit(F.col(ra), F.col(dec))
    number = lambda c: F.least(F.floor((F.col(c) + 1) * 2.0 ** (FINEST - 1)), F.lit((1 << FINEST) - 1)).cast("int")
    once = source.where(F.col(ra).isNotNull() & F.col(dec).isNotNull()).groupBy(ra, dec).agg(F.min(key).alias("id"))
    placed = once.select("id", x.alias("x"), y.alias("y"), z.alias("z"))
    places = staged(placed.withColumns(dict(zip(("i", "j", "k"), map(number, AXES), strict=True))), "places")
    cells = staged(places.groupBy("i", "j", "k").agg(F.count("*").alias("n"), F.min(F.struct(*AXES)).alias("one")), "cells")
    n_cells, level = cells.count(), 1
    if not n_cells:
        raise ValueError("the source has no place")
    while level < FINEST and 4**level * FULL < 16 * n_cells:  # about 4^level cells hold the sphere's surface
        level += STEP
    while level < FINEST and cells.groupBy(_packed(level)).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > FULL:
        level += STEP
    return Hierarchy(places, cells, n_cells, level)


def _children(tree: Hierarchy, level: int, above: int) -> DataFrame:
    """The cells of a level: cell, parent, its lower corner, and a place in it."""
    edge = 2.0 ** (1 - level)
    grouped = tree.cells.groupBy(_packed(level).alias("cell"), _packed(above).alias("parent")).agg(F.min("one").alias("one"))
    corners = [(F.shiftright("cell", 20 * (2 - a)).bitwiseAND(F.lit((1 << 20) - 1)) * edge - 1).alias(f"low_{c}") for a, c in enumerate(AXES)]
    out = grouped.select("cell", "parent", *corners, *[F.col(f"one.{c}").alias(f"one_{c}") for c in AXES])
    return F.broadcast(out) if min(tree.n_cells, 8 * 4**level) <= BROADCAST_CELLS else out


def _squared(parts: list[Column]) -> Column:
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def nearest_anywhere(left: DataFrame, source: DataFrame, on: tuple[str, str, str, str], left_id: str, source_id: str) -> DataFrame:
    """left_id, source_id, separation_arcsec: each left row's nearest source row however far, ties to the smaller id.

    on: ra, dec of left, ra, dec of the source. Left rows of one id and place count once; those without a place get no row. A
    row's cells at a level lie on a ring about it no wider than they are themselves, so neither pairs nor rings grow with the source's
    rows: a cluster in one cell is cut up until its cells hold FULL places.
    """
    tree = hierarchy(source, on[2], on[3], source_id)
    p = [c.alias(f"p_{a}") for c, a in zip(sky.unit(F.col(on[0]), F.col(on[1])), AXES, strict=True)]
    rows = left.where(F.col(on[0]).isNotNull() & F.col(on[1]).isNotNull()).select(F.col(left_id).alias("row"), *p).distinct()
    rows = rows.withColumns({"cell": F.lit(0).cast("long"), "best": F.lit(2.0)})
    own, above = [F.col(f"p_{a}") for a in AXES], 0
    for level in range(1, tree.level + 1, STEP):
        edge = 2.0 ** (1 - level)
        below = _children(tree, level, above).withColumnRenamed("cell", "child")
        met = rows.join(below, F.col("cell") == F.col("parent"))
        low = [F.col(f"low_{a}") for a in AXES]
        gap = F.sqrt(_squared([F.greatest(c - x, x - c - edge, F.lit(0.0)) for x, c in zip(own, low, strict=True)]))
        known = F.sqrt(_squared([x - F.col(f"one_{a}") for x, a in zip(own, AXES, strict=True)]))
        met = met.select("row", *own, "best", F.col("child").alias("cell"), gap.alias("gap"), known.alias("known"))
        best = F.least("best", F.min("known").over(Window.partitionBy("row", *own)))
        rows = met.withColumn("best", best).where(F.col("gap") <= F.col("best") + NOTHING).drop("gap", "known")
        above = level
    places = tree.places.select(_packed(tree.level).alias("cell"), "id", *AXES)
    d = _squared([x - F.col(a) for x, a in zip(own, AXES, strict=True)])
    near = rows.join(places, "cell").where(F.sqrt(d) <= F.col("best") + NOTHING)
    found = near.groupBy("row").agg(F.min(F.struct(F.round(sky.arcsec(d), 6).alias("s"), "id")).alias("m"))
    return found.select(F.col("row").alias(left_id), F.col("m.id").alias(source_id), (F.col("m.s") + 0.0).alias("separation_arcsec"))
