"""Spatial joins: unit vectors in cells of twice the search radius, so that they are equi-joins.

The right side is copied into the cells that its radius reaches, two an axis at most, so 8 in all and often 1; the
poles and right ascension 0 need no special case.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterfold.functions import sky
from asterfold.operators import validation
from asterfold.operators.nearest import nearest_anywhere
from asterfold.sources.scratch import staged

#: Smallest cell edge: more cells than 2^21 an axis don't fit a packed key.
LEAST_EDGE = 2.0**-19
#: Rows and copies that a task of a join holds, and how many times k right rows the first radius of a search should hold.
TASK_ROWS, CROWD = 100_000, 3


def with_cells(df: DataFrame, ra: str, dec: str, edge: float, reach: float | None) -> DataFrame:
    """The cell of each place, or, copied, the cells within `reach` of it along the axes."""
    x, y, z = sky.unit(F.col(ra), F.col(dec))
    df = df.withColumns({"__x": x, "__y": y, "__z": z})
    packed = lambda cells: (cells[0] * (1 << 21) + cells[1]) * (1 << 21) + cells[2]
    axis = lambda c, by: F.floor((F.col(c) + by) / edge) + (1 << 20)
    if reach is None:
        return df.withColumn("__cell", packed([axis(c, 0.0) for c in ("__x", "__y", "__z")]))
    sides = [(axis(c, -reach), axis(c, reach)) for c in ("__x", "__y", "__z")]
    return df.withColumn("__cell", F.explode(F.array_distinct(F.array(*[packed(cells) for cells in itertools.product(*sides)]))))


def tasks_of(left: DataFrame, right_rows: int) -> int:
    return max(left.sparkSession.sparkContext.defaultParallelism, -(-(left.count() + 8 * right_rows) // TASK_ROWS))


def pairs_within(left: DataFrame, right: DataFrame, radius_arcsec: float, on: tuple[str, str, str, str], how: str = "inner") -> DataFrame:
    """left joined with right rows within the radius; adds separation_arcsec. on: ra, dec of left, ra, dec of right.

    Column names of the sides must differ. The right side is copied up to 8 times: give the smaller one. Pairs stream out of a hash
    join of each task's cells: neither side is broadcast or sorted.
    """
    # exploded, lest filters on it move into the join's condition, where each row of a cell would be measured and rounded
    return _met(left, right, radius_arcsec, on, how).withColumn("separation_arcsec", F.explode(F.array(separation(F.col("__squared"))))).drop("__squared")


def separation(squared: Column) -> Column:
    return F.round(sky.arcsec(squared), 6)


def _met(left: DataFrame, right: DataFrame, radius_arcsec: float, on: tuple[str, str, str, str], how: str = "inner", tasks: int | None = None) -> DataFrame:
    """pairs_within() with the squared chord as __squared. tasks: as tasks_of() has it, if it is known."""
    reach = max(sky.chord(radius_arcsec) * 1.0001, LEAST_EDGE / 2)
    tasks = tasks or tasks_of(left, right.count())
    a = with_cells(left, on[0], on[1], 2 * reach, None).repartition(tasks, "__cell")
    b = with_cells(right, on[2], on[3], 2 * reach, reach)
    b = b.withColumnsRenamed({c: f"{c}r" for c in ("__x", "__y", "__z", "__cell")}).repartition(tasks, "__cellr").hint("shuffle_hash")
    squared = sum(((F.col(c) - F.col(f"{c}r")) * (F.col(c) - F.col(f"{c}r")) for c in ("__y", "__z")), (F.col("__x") - F.col("__xr")) * (F.col("__x") - F.col("__xr")))
    joined = a.join(b, (F.col("__cell") == F.col("__cellr")) & (squared <= sky.chord(radius_arcsec) ** 2), how)
    return joined.withColumn("__squared", squared).drop("__x", "__y", "__z", "__xr", "__yr", "__zr", "__cell", "__cellr")


def reaches(right: DataFrame, radius_arcsec: float, on: tuple[str, str, str, str], k: int) -> list[float]:
    """Radii, each four times the one before, that end at the given one: the first should hold a few times k right rows.

    How many it holds comes from the crowd that a right row meets in its cell, over all of them.
    """
    edge = 2 * max(sky.chord(radius_arcsec) * 1.0001, LEAST_EDGE / 2)
    cells = with_cells(right.select(on[2], on[3]), on[2], on[3], edge, None).groupBy("__cell").agg(F.count("*").cast("double").alias("n"))
    crowd = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    first = radius_arcsec * min(1.0, 2 * math.sqrt(CROWD * k / (math.pi * max(crowd, 1.0))))
    out = [float(radius_arcsec)]
    while out[0] / 2 > first:
        out.insert(0, max(first, out[0] / 4))
    return out


def nearest(left: DataFrame, right: DataFrame, radius_arcsec: float, on: tuple[str, str, str, str], left_id: str, right_id: str, k: int = 1, how: str = "inner") -> DataFrame:
    """The k nearest right rows of each left row within the radius, ranked by (separation, right id).

    Where the radius holds many times k rows, a smaller one is searched first, and only left rows that meet fewer than k there go on
    to a larger one; so pairs grow with the rows, not with their product.
    """
    if k == 1:
        near = _first(left, right, radius_arcsec, on, left_id, right_id, how)
    else:
        near = _several(left, right, radius_arcsec, on, left_id, k, how)
    rank = F.expr(f"cast(row_number() over (partition by {left_id} order by separation_arcsec nulls last, {right_id}) as int)")
    return near.withColumn("candidate_rank", rank).where(F.col("candidate_rank") <= k)


def _several(left: DataFrame, right: DataFrame, radius_arcsec: float, on: tuple[str, str, str, str], left_id: str, k: int, how: str) -> DataFrame:
    """Pairs that hold the k nearest of each left row."""
    *small, radius = reaches(right, radius_arcsec, on, k)
    rest, found = left, None
    for r in small:
        near = pairs_within(rest, right, r, on)
        # what lies beyond r is farther than these even when rounded
        inside = near.where(F.col("separation_arcsec") <= r - 2e-6)
        met = staged(inside.groupBy(left_id).agg(F.count("*").alias("__n")).where(F.col("__n") >= k).select(left_id), "met")
        part = near.join(met.hint("shuffle_hash"), left_id, "left_semi")
        found = part if found is None else found.unionByName(part)
        rest = rest.join(met.hint("shuffle_hash"), left_id, "left_anti")
    near = pairs_within(rest, right, radius, on, how)
    return near if found is None else found.unionByName(near)


def _first(left: DataFrame, right: DataFrame, radius_arcsec: float, on: tuple[str, str, str, str], left_id: str, right_id: str, how: str) -> DataFrame:
    """The pair of each left row with its nearest right row, ties to the smaller id.

    Different places are searched, not rows: each of left's once, for each of right's once with its smallest id; so copies of a place
    make no pairs. Two minima of fixed width go over the pairs, the squared chord and then the id among those at its separation; so a
    task holds its places, but no pairs, however many lie within the radius. Pairs are neither exchanged nor sorted, and only
    those that may be at the least separation are rounded: it grows with the chord, so the least of either is the same pair's.
    """
    place = [on[0], on[1]]
    smallest = F.when(F.count("*") == F.count(right_id), F.min(right_id))  # a null id comes first, as it does in an order
    there = right.where(F.col(on[2]).isNotNull() & F.col(on[3]).isNotNull())
    spots = staged(there.groupBy(on[2], on[3]).agg(smallest.alias(right_id)), "spots")
    own = spots.select(F.col(on[2]).alias("__own0"), F.col(on[3]).alias("__own1"), F.col(right_id).alias("__own2")).hint("shuffle_hash")
    rows = there.join(own, (F.col(on[2]) == F.col("__own0")) & (F.col(on[3]) == F.col("__own1")) & F.col(right_id).eqNullSafe(F.col("__own2")), "left_semi")
    rest, found, n_spots = staged(left.select(*place).dropna().distinct(), "places"), None, spots.count()
    for r in (radii := reaches(spots, radius_arcsec, on, 1)):
        tasks = tasks_of(rest, n_spots)
        chord = _met(rest, spots, r, on, tasks=tasks).groupBy(*place).agg(F.min("__squared").alias("__chord"))
        # what lies beyond a radius but the last is farther than these even when rounded
        inside = F.col("__least") <= (r - 2e-6 if r < radii[-1] else float("inf"))
        least = staged(chord.select(*place, separation(F.col("__chord")).alias("__least")).where(inside), "least")
        ties = _at_least(least, spots, r, on, tasks)
        first = staged(ties.groupBy(*place, "__least").agg(smallest.alias("__first")), "first")
        met = _at_least(first, rows, r, on, tasks).where(F.col(right_id).eqNullSafe(F.col("__first"))).withColumnRenamed("__least", "separation_arcsec").drop("__first")
        met = met.select(*place, *right.columns, "separation_arcsec")
        found = met if found is None else found.unionByName(met)
        rest = staged(rest.join(first.select(*place).hint("shuffle_hash"), place, "left_anti"), "rest") if r < radii[-1] else rest
    found = found.withColumnsRenamed({on[0]: "__own0", on[1]: "__own1"}).hint("shuffle_hash")
    return left.join(found, (F.col(on[0]) == F.col("__own0")) & (F.col(on[1]) == F.col("__own1")), how).drop("__own0", "__own1")


def _at_least(left: DataFrame, right: DataFrame, radius_arcsec: float, on: tuple[str, str, str, str], tasks: int) -> DataFrame:
    """Pairs whose rounded separation is the left row's __least."""
    within = 2 * F.sin(F.radians((F.col("__least") + 1e-6) / 3600) / 2)
    near = _met(left.withColumn("__most", within * within * (1 + 1e-9)), right, radius_arcsec, on, tasks=tasks).where("__squared <= __most")
    return near.withColumn("__at", F.explode(F.array(separation(F.col("__squared"))))).where("__at = __least").drop("__squared", "__most", "__at")


def self_match(source: DataFrame, ra: str, dec: str, key: str, radius_arcsec: float = 1.0, own_first: bool = False) -> DataFrame:
    """key, match, separation_arcsec of each row's nearest row in its own table: a check of a matcher before it is trusted.

    Each row must be met at distance 0, by itself or, where rows share a place, by the smallest key there; else raises, as do repeated
    keys. Rows without a place raise. own_first: of rows at distance 0 the row itself comes first, and it must be met by itself.
    """
    rows = validation.require_unique(source.select(key, ra, dec), key)
    copy = rows.select(F.col(key).alias("match"), F.col(ra).alias("__ra"), F.col(dec).alias("__dec"))
    on = (ra, dec, "__ra", "__dec")
    rules = {"rows not met": F.col("match").isNull(), "rows met elsewhere": F.col("separation_arcsec") > 0, "rows met by a larger key": F.col("match") > F.col(key)}
    if own_first:
        near = pairs_within(rows, copy, radius_arcsec, on).groupBy(key).agg(F.min("separation_arcsec").alias("separation_arcsec"), F.min(F.when(F.col("match") == F.col(key), F.col("separation_arcsec"))).alias("__own"))
        own = F.when(F.col("__own") == F.col("separation_arcsec"), F.col(key)).alias("match")
        found = rows.select(key).join(near, key, "left").select(key, own, "separation_arcsec")
        rules = {"rows not met": F.col("separation_arcsec").isNull(), "rows met elsewhere": F.col("match").isNull() | (F.col("separation_arcsec") > 0)}
    else:
        found = nearest(rows, copy, radius_arcsec, on, key, "match", how="left").select(key, "match", "separation_arcsec")
    return validation.require(found, rules)


def untruncated(matches: DataFrame, k: int) -> DataFrame:
    """The ranked matches; raises, when they are read, where a list reaches k, for it may have been cut short."""
    full = F.when(F.col("candidate_rank") >= k, F.raise_error(F.lit(f"a list of matches reaches {k}"))).otherwise(F.col("candidate_rank"))
    return matches.withColumn("candidate_rank", full)


def one_to_one(matches: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Of the matches of a right row the nearest, ties by left id."""
    return matches.withColumn("__r", F.expr(f"row_number() over (partition by {right_id} order by separation_arcsec, {left_id})")).where("__r = 1").drop("__r")


def coverage(benchmark: DataFrame, source: DataFrame, radius_arcsec: float, on: tuple[str, str, str, str], benchmark_id: str, source_id: str) -> DataFrame:
    """Every benchmark row with its nearest source: status matched or absent; benchmark-major. Absent rows have no separation."""
    found = nearest(benchmark, source, radius_arcsec, on, benchmark_id, source_id, 1, "left")
    return found.select(benchmark_id, F.when(F.col(source_id).isNull(), "absent").otherwise("matched").alias("status"), F.col(source_id).alias("source_object_id"), "separation_arcsec")


def full_coverage(benchmark: DataFrame, source: DataFrame, radius_arcsec: float, on: tuple[str, str, str, str], benchmark_id: str, source_id: str) -> DataFrame:
    """coverage(), with the separation from the nearest source of absent rows too, which name no source."""
    found = nearest_anywhere(benchmark, source, on, benchmark_id, source_id)
    rows = benchmark.select(benchmark_id).join(found, benchmark_id, "left")
    matched = F.coalesce(F.col("separation_arcsec") <= radius_arcsec, F.lit(False))
    status = F.when(matched, "matched").otherwise("absent")
    return rows.select(benchmark_id, status.alias("status"), F.when(matched, F.col(source_id)).alias("source_object_id"), "separation_arcsec")


def absent_separations(absent: DataFrame, source: DataFrame, on: tuple[str, str, str, str], benchmark_id: str, source_id: str) -> DataFrame:
    """Nearest source at any distance of the benchmark rows without a match, as source_object_id and separation_arcsec."""
    return nearest_anywhere(absent, source, on, benchmark_id, source_id).withColumnRenamed(source_id, "source_object_id")


def exclusions(source: DataFrame, benchmarks: DataFrame, radius_arcsec: float, on: tuple[str, str, str, str], source_id: str, reason: str) -> DataFrame:
    """Source rows near any benchmark row: sorted distinct reasons and the least separation; source-major."""
    near = nearest_per_reason(source, benchmarks, radius_arcsec, on, source_id, reason)
    return near.groupBy(source_id).agg(F.array_join(F.array_sort(F.collect_set(reason)), ";").alias("reason"), F.min("separation_arcsec").alias("separation_arcsec"))


def nearest_per_reason(source: DataFrame, benchmarks: DataFrame, radius_arcsec: float, on: tuple[str, str, str, str], source_id: str, reason: str) -> DataFrame:
    return pairs_within(source, benchmarks, radius_arcsec, on).groupBy(source_id, reason).agg(F.min("separation_arcsec").alias("separation_arcsec"))


def match_summary(source: DataFrame, candidates: DataFrame, radii: list[float], source_id: str, target_id: str, survey: str, selection: str) -> DataFrame:
    """Per radius, overall and by survey and by selection: sources, any and valid matches, ambiguous ones.

    Overall rows (null survey and selection) also count valid candidates, the targets that are some source's nearest
    valid one, and those that several share. One join at the largest radius serves all radii; candidates need
    separation_arcsec and is_valid.
    """
    near = F.col("separation_arcsec")
    within = lambda r: near <= float(r)
    valid = F.coalesce(F.col("is_valid"), F.lit(False))
    # fixed-width sums and minima alone: they need neither a sort of the candidates nor a copy of them for each radius
    counts = [c for n, r in enumerate(radii) for c in (F.count_if(within(r)).alias(f"__any{n}"), F.count_if(within(r) & valid).alias(f"__valid{n}"))]
    own = staged(candidates.groupBy(source_id).agg(*counts, F.min(F.when(valid & within(max(radii)), near)).alias("__near")), "sources")
    least = own.where("__near is not null").select(F.col(source_id).alias("__source"), "__near")
    # the nearest valid target of the largest radius is that of each radius that reaches it
    first = candidates.where(valid & within(max(radii))).join(least.hint("shuffle_hash"), (F.col(source_id) == F.col("__source")) & (near == F.col("__near")), "left_semi").groupBy(source_id).agg(F.min(target_id).alias("__first"))
    each = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.col(f"__any{n}").alias("n_any"), F.col(f"__valid{n}").alias("n_valid"), F.when(F.col("__near") <= float(r), F.col("__first")).alias("selected")) for n, r in enumerate(radii)])).alias("x")
    per = staged(own.join(first, source_id, "left").select(source_id, each).select(source_id, "x.*").where("n_any > 0"), "radii")
    radius = F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("radius")
    every = source.select(source_id, survey, selection, radius).join(per, ["radius", source_id], "left")
    sums = [F.count("*").alias("sources"), F.count_if(F.coalesce("n_any", F.lit(0)) > 0).alias("any_match"), F.count_if(F.coalesce("n_valid", F.lit(0)) > 0).alias("valid_match"), F.count_if(F.coalesce("n_valid", F.lit(0)) > 1).alias("ambiguous"), F.coalesce(F.sum("n_valid"), F.lit(0)).alias("valid_candidates")]
    grouped = every.groupingSets([["radius"], ["radius", survey], ["radius", selection]], "radius", survey, selection).agg(*sums, F.grouping_id().alias("__level"))
    targets = per.where("selected is not null").groupBy("radius", "selected").agg(F.count("*").alias("n")).groupBy("radius").agg(F.count("*").alias("selected_targets"), F.count_if(F.col("n") > 1).alias("shared_targets"))
    overall = F.col("__level") == 3
    out = grouped.join(F.broadcast(targets), "radius", "left").withColumn("valid_fraction", F.round(F.col("valid_match") / F.col("sources"), 6))
    return out.withColumns({c: F.when(overall, F.coalesce(c, F.lit(0))) for c in ("valid_candidates", "selected_targets", "shared_targets")}).drop("__level")
