"""Manifests, exclusions, coverage, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterfold.functions import hashing
from asterfold.operators import order, validation
from asterfold.sources.scratch import staged


def combine_exclusions(*sets: DataFrame, key: str = "object_id") -> DataFrame:
    """(key, reason) tables to one row a key with its sorted distinct reasons joined by semicolons."""
    every = sets[0].select(key, "reason")
    for s in sets[1:]:
        every = every.unionByName(s.select(key, "reason"))
    return every.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("reason"))


def build_manifest(source: DataFrame, exclusions: DataFrame, seed: int, train_ratio: float, version: str, key: str = "object_id") -> DataFrame:
    """source with exclusion reason and flag, split (excluded before train before validation), seed and version."""
    reason = exclusions.select(F.col(key), F.col("reason").alias("benchmark_exclusion_reason"))
    joined = source.join(reason, key, "left").withColumn("benchmark_exclusion_reason", F.coalesce("benchmark_exclusion_reason", F.lit("")))
    out = F.col("benchmark_exclusion_reason") != ""
    return joined.withColumns({
        "benchmark_exclusion": out, "split": F.when(out, "excluded").otherwise(hashing.split(F.col(key), seed, train_ratio)),
        "split_seed": F.lit(seed), "image_embedding_version": F.lit(version),
    })


def exact_coverage(source: DataFrame, excluded: DataFrame, name: str, key: str = "object_id") -> DataFrame:
    """Every excluded id: matched or absent in the source, by id. A repeated excluded id raises."""
    mine = source.select(F.col(key).alias("source_object_id")).distinct()
    ids = validation.require_unique(excluded, key).select(F.col(key).alias("exclusion_id"))
    joined = ids.join(mine, ids.exclusion_id == mine.source_object_id, "left")
    matched = F.col("source_object_id").isNotNull()
    return joined.select(F.lit(name).alias("exclusion_set"), "exclusion_id", F.when(matched, "matched").otherwise("absent").alias("status"), "source_object_id", F.when(matched, 0.0).alias("separation_arcsec"))


def fill_population(source: DataFrame, anchors: DataFrame, priorities: DataFrame, n: int, salt: str, seed: int, key: str = "object_id", excluded: DataFrame | None = None) -> DataFrame:
    """Exactly n rows: anchors first, then priorities by their rank, then the rest by hash; with reason and rank.

    anchors: (key); priorities: (key, priority_rank), of a repeated key the first rank; excluded: (key), which may be
    neither. Anchors or priorities that the source lacks or that are excluded, more anchors than n, and fewer
    eligible rows than n raise, as does a repeated source key. Keys alone are tagged, written once and checked;
    whole tiers are taken as far as they fit, the last one by counts of hashes or by ranges of ranks, so neither the first n nor
    their ranks need one task; the source is joined to the chosen keys.
    """
    if n <= 0 or not salt.strip():
        raise ValueError("a population needs a positive size and a salt")
    wanted = anchors.select(key).distinct().withColumn("__anchor", F.lit(True)).join(priorities.groupBy(key).agg(F.min("priority_rank").alias("__rank")), key, "full_outer")
    out = (excluded.select(key).distinct() if excluded is not None else source.select(key).limit(0)).withColumn("__out", F.lit(True))
    mine = source.groupBy(key).agg(F.count("*").alias("__n"))
    keys = staged(mine.join(wanted, key, "full_outer").join(out, key, "left"), "population")
    asked, eligible = F.col("__anchor").isNotNull() | F.col("__rank").isNotNull(), F.col("__n").isNotNull() & F.col("__out").isNull()
    counts = {
        "duplicate": F.col("__n") > 1, "asked for but not in the source": asked & F.col("__n").isNull(), "asked for but excluded": asked & F.col("__out").isNotNull(),
        "rows": eligible, "anchors": eligible & F.col("__anchor").isNotNull(), "priorities": eligible & F.col("__anchor").isNull() & F.col("__rank").isNotNull()}
    found = validation.violations(keys, counts).first().asDict()
    broken = {k: v for k, v in found.items() if v and k not in ("rows", "anchors", "priorities")}
    if broken:
        raise ValueError(f"keys {broken}")
    if found["anchors"] > n or found["rows"] < n:
        raise ValueError(f"{n} rows asked for, {found['anchors']} anchors, {found['rows']} eligible rows")
    reason = F.when(F.col("__anchor"), "anchor").when(F.col("__rank").isNotNull(), "priority").otherwise("hash_fill")
    tagged = keys.where(eligible).select(key, reason.alias("selection_reason"), "__rank")
    tier = lambda name: tagged.where(F.col("selection_reason") == name)
    kept = ["selection_reason", key]
    chosen, left = tier("anchor").select(*kept), n - found["anchors"] - found["priorities"]
    if left >= 0:
        chosen = chosen.unionByName(tier("priority").select(*kept))
        if left:
            chosen = chosen.unionByName(hashing.exact_sample(tier("hash_fill").select(*kept), key, left, salt, seed))
    else:
        first = order.ranked_along(tier("priority"), [], [F.col("__rank"), hashing.selection_key(salt, F.col(key), seed), F.col(key)], "__place")
        chosen = chosen.unionByName(first.where(F.col("__place") <= n - found["anchors"]).select(*kept))
    chosen = chosen.withColumns({"__hash": hashing.selection_key(salt, F.col(key), seed), "__all": F.lit(0)})
    ranked = order.ranked(chosen, ["__all"], order.hex_bucket(F.col("__hash")), [F.col("__hash"), F.col(key)], "selection_rank")
    return source.join(ranked.select(*kept, (F.col("selection_rank") - 1).alias("selection_rank")), key)


def common_ids(*manifests: DataFrame, split: str | None = None, key: str = "object_id") -> DataFrame:
    """Keys that all manifests have, of one split if given."""
    kept = [m.where(F.col("split") == split) if split else m for m in manifests]
    out = kept[0].select(key).distinct()
    for m in kept[1:]:
        out = out.join(m.select(key), key, "left_semi")
    return out


def resolve(rows: DataFrame, done: DataFrame, key: str = "object_id") -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key), key, "left_anti")


def normalize_source(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """object_id, survey, ra, dec, source_row_id of a raw catalog; places off the sphere, null ids and repeated ids raise."""
    kinds = {"object_id": "string", "survey": "string", "ra": "double", "dec": "double", "source_row_id": "long"}
    out = rows.select(*[columns[c].cast(kind).alias(c) for c, kind in kinds.items()])
    inside = lambda c, lo, hi: F.coalesce((F.col(c) >= lo) & hi, F.lit(False))
    rules = {"ra": ~inside("ra", 0, F.col("ra") < 360), "dec": ~inside("dec", -90, F.col("dec") <= 90), "no id": F.col("object_id").isNull()}
    return validation.require_unique(validation.require(out, rules), "object_id")
