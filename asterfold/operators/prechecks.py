"""Checks before a large run: does a wider grid of penalties change a conclusion, and how far does a catalog of labels cover a set of pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterfold.functions import scores
from asterfold.operators import bins, order, probes, sphere, stats, validation
from asterfold.sources.scratch import staged

SCALES = ("absolute", "one_plus_z")


@dataclass(frozen=True)
class Sensitivity:
    """predictions: of both grids. selection: each grid's, condition's and seed's alpha. contrasts: before and after, with the change."""

    predictions: DataFrame
    selection: DataFrame
    contrasts: DataFrame


def require_prints(df: DataFrame, key: str, vector: str, parts: dict[str, list[int]], prints: dict[str, dict]) -> DataFrame:
    """df, if (key, the part of the vector) of each condition has the fingerprint given for it; else raises."""
    if set(prints) - set(parts):
        raise ValueError(f"fingerprints of unknown conditions: {sorted(set(prints) - set(parts))}")
    for name, wanted in prints.items():
        picked = F.array(*[F.col(vector)[d] for d in parts[name]])
        found = validation.fingerprint(df.select(F.col(key).alias("object_id"), picked.alias("vector"))).first().asDict()
        if found != {k: wanted[k] for k in found}:
            raise ValueError(f"cached {name} changed: {found}, not {wanted}")
    return df


def alpha_sensitivity(df: DataFrame, key: str, vector: str, target: str, parts: dict[str, list[int]], contrasts: dict[str, tuple[str, str]], seeds: list[int], train_ratio: float, folds: int,
                      before: list[float], after: list[float], samples: int, draw: int, prints: dict[str, dict] | None = None) -> Sensitivity:
    """Ridge on parts of cached vectors under two grids of alphas: does a conclusion hold under the wider one?

    contrasts: name -> (base, other), by how much `other` errs less, absolutely and over 1 + true. Both grids are fitted in the same passes over the
    same splits, and their intervals come from the same resamples, so the change of a contrast has an interval of its own. prints: what
    the cached conditions' fingerprints (require_prints) must be. Repeated keys raise. An object without a test row of both conditions counts nowhere.
    """
    unknown = {c for pair in contrasts.values() for c in pair} - set(parts)
    if unknown or not contrasts:
        raise ValueError(f"contrasts need conditions of {sorted(parts)}, not {sorted(unknown)}")
    validation.require_unique(df, key)
    require_prints(df, key, vector, parts, prints or {})
    grids = {"before": before, "after": after}
    said = staged(probes.modality_grids(df, key, vector, target, parts, seeds, train_ratio, folds, grids), "sensitivity")
    edges = [probes.alpha_edges(said.where(F.col("grid") == g), a).select(F.lit(g).alias("grid"), "*") for g, a in grids.items()]
    return Sensitivity(said, edges[0].unionByName(edges[1]), _changes(said, contrasts, samples, draw, max(after)))


def _changes(said: DataFrame, contrasts: dict[str, tuple[str, str]], samples: int, draw: int, largest: float) -> DataFrame:
    error = F.abs(F.col("y_pred_numeric") - F.col("y_true_numeric"))
    scaled = dict(zip(SCALES, (error, error / (1 + F.col("y_true_numeric"))), strict=True))
    of = lambda g, c, e: F.avg(F.when((F.col("grid") == g) & (F.col("encoder") == c), e))
    named = {(n, s): f"c{k}" for k, (n, s) in enumerate((n, s) for n in contrasts for s in SCALES)}
    less = {f"{g}_{c}": of(g, contrasts[n][0], scaled[s]) - of(g, contrasts[n][1], scaled[s]) for (n, s), c in named.items() for g in ("before", "after")}
    per = said.groupBy("object_id", "split_seed").agg(*[c.alias(n) for n, c in less.items()])
    objects = per.groupBy("object_id").agg(*[F.avg(n).alias(n) for n in less])
    objects = objects.withColumns({f"change_{c}": F.col(f"after_{c}") - F.col(f"before_{c}") for c in named.values()})
    found = stats.shared_bootstrap(objects, "object_id", [f"{g}_{c}" for c in named.values() for g in ("before", "after", "change")], samples, draw)
    at_max = said.where((F.col("grid") == "after") & (F.col("hyperparameter_value") == float(largest))).agg(F.count_distinct("encoder", "split_seed").alias("selected_at_new_max"))
    tags = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).alias("comparison"), F.lit(s).alias("scale")) for (n, s), c in named.items()])).alias("t")
    rows = found.select(F.split("contrast", "_")[0].alias("g"), F.split("contrast", "_")[1].alias("c"), "estimate", "ci_low", "ci_high", "objects")
    pick = lambda g, c: F.max(F.when(F.col("g") == g, F.col(c)))
    wide = rows.groupBy("c").agg(pick("before", "objects").alias("objects"), *[pick(g, c).alias(n) for g in ("before", "after", "change") for c, n in (("estimate", g), ("ci_low", f"{g}_low"), ("ci_high", f"{g}_high"))])
    out = at_max.select("*", tags).select("selected_at_new_max", "t.*").join(wide, "c").drop("c")
    out = out.withColumns({f"decision_{g}": stats.decision(F.col(f"{g}_low"), F.col(f"{g}_high")) for g in ("before", "after")})
    return out.withColumn("holds", F.col("decision_before") == F.col("decision_after"))


@dataclass(frozen=True)
class CoverageAudit:
    """labelled: pairs with a match and their flags. unmatched: the other pairs. counts: by label. crosstab: by interval and label. summary: one row."""

    labelled: DataFrame
    unmatched: DataFrame
    counts: DataFrame
    crosstab: DataFrame
    summary: DataFrame


def coverage_audit(pairs: DataFrame, catalog: DataFrame, radius_arcsec: float, on: tuple[str, str, str, str], pair_id: str, catalog_id: str, value: str, labels: dict[str, Column], edges: list[float],
                   expected_pairs: int | None = None, catalog_print: dict | None = None, shared: bool = False) -> CoverageAudit:
    """How far a catalog's labels cover the pairs, overall and within [edge, next edge) of a value.

    labels: a flag each over the catalog's columns; a null flag is false. Each pair takes its nearest catalog row within the radius, ties to the smaller id. A catalog row
    that several pairs take raises, unless `shared` allows and counts it. Raise, too: repeated or null pair ids, values that aren't
    finite, edges that don't ascend, another number of pairs than expected, a catalog whose fingerprint isn't `catalog_print`.
    Without matches the fractions are 0 and the separations null.
    """
    if len(edges) < 2 or any(not a < b for a, b in zip(edges, edges[1:], strict=False)) or any(abs(e) == float("inf") for e in edges):
        raise ValueError(f"edges must be finite and ascend: {edges}")
    if expected_pairs is not None:
        validation.require_rows(pairs, expected_pairs)
    if catalog_print is not None and validation.fingerprint(catalog).first().asDict() != catalog_print:
        raise ValueError("the catalog isn't the one that was named")
    validation.require(validation.require_unique(pairs, pair_id), {"ids null": F.col(pair_id).isNull(), "values not finite": ~scores.finite(F.col(value))})
    flagged = catalog.select(catalog_id, on[2], on[3], *[F.coalesce(c, F.lit(False)).alias(f"reliable_{n}") for n, c in labels.items()])
    every = staged(sphere.nearest(pairs, flagged, radius_arcsec, on, pair_id, catalog_id, how="left").drop("candidate_rank", on[2], on[3]), "coverage")
    met = F.col(catalog_id).isNotNull()
    labelled = every.where(met)
    if not shared:
        validation.require_unique(labelled, catalog_id)
    flags = {n: met & F.coalesce(F.col(f"reliable_{n}"), F.lit(False)) for n in labels}
    outside = ~((F.col(value) >= float(edges[0])) & (F.col(value) < float(edges[-1])))
    whole = every.agg(F.count("*").alias("total_pairs"), F.count_if(met).alias("matched_pairs"), F.count_if(outside).alias("pairs_outside_bins"), F.count_if(met & outside).alias("matched_outside_bins"),
                      F.max("separation_arcsec").alias("separation_max"), *[F.count_if(c).alias(f"reliable_{n}") for n, c in flags.items()])
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"reliable_{n}").alias("positive_objects")) for n in labels])).alias("x")
    counts = whole.select("total_pairs", "matched_pairs", each).select("x.label", "x.positive_objects", "matched_pairs", "total_pairs")
    counts = counts.select("label", "positive_objects", share("positive_objects", "matched_pairs").alias("fraction_of_matches"), share("positive_objects", "total_pairs").alias("fraction_of_all_pairs"))
    table = every.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(edges, edges[1:], strict=False)], "low double, high double")
    binned = bins.counted(every, value, table, "low", "high", ["low", "high"], total_objects=F.lit(1), matched_objects=met, **{f"reliable_{n}": c for n, c in flags.items()})
    crosstab = binned.select("low", "high", "total_objects", "matched_objects", share("matched_objects", "total_objects").alias("match_fraction"), each).select("low", "high", "total_objects", "matched_objects", "match_fraction", "x.*")
    taken = labelled.groupBy(catalog_id).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_assignments"))
    middle = order.quantiles(labelled, [], "separation_arcsec", [0.5, 0.95]).agg(*[F.max(F.when(F.col("k") == k, F.round("value", 6) + 0.0)).alias(f"separation_{n}") for k, n in enumerate(("median", "p95"))])
    summary = whole.crossJoin(taken).crossJoin(middle).withColumn("coverage_fraction", share("matched_pairs", "total_pairs"))
    return CoverageAudit(labelled, every.where(~met).select(*pairs.columns), counts, crosstab, summary.drop(*[f"reliable_{n}" for n in labels]))
