"""Embedding caches: vectors with where they come from, checked, written and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.functions import vectors
from asterfold.operators import validation
from asterfold.sources import tables
from asterfold.sources.scratch import staged

#: Rows of a row group of a cache in key order; ids that a filter names, ids of one list of it, and ranges of more ids.
GROUP_ROWS, LISTED, TOGETHER, RANGES = 20_000, 1_000, 10, 200


def ingest(source: DataFrame, key: str, text: str, vector: str, model_id: str, revision: str, atol: float = 1e-3, role: str = "document", instruction: str = "") -> DataFrame:
    """Vectors of texts as cache rows of the eleven columns; vectors are kept as they are, as floats."""
    e = F.transform(vector, lambda x: x.cast("float"))
    return source.select(
        F.col(key).cast("string").alias("object_id"), F.col(text).cast("string").alias("text"), e.alias("embedding"), F.lit(role).alias("role"), F.lit(model_id).alias("model_id"),
        F.lit(revision).alias("revision"), F.lit(instruction).alias("instruction"), F.sha2(F.lit(instruction), 256).alias("instruction_hash"), F.sha2(F.col(text).cast("string"), 256).alias("source_checksum"),
        F.size(vector).alias("output_dim"), F.coalesce(vectors.is_unit(e, atol), F.lit(False)).alias("normalized"))


def renormalized(cache: DataFrame, atol: float = 1e-3) -> DataFrame:
    """The cache with unit vectors; a vector without a direction raises when it is read. One projection, no second file."""
    unit = F.coalesce(vectors.normalized(F.col("embedding")), F.raise_error(F.concat(F.lit("no direction: "), F.col("object_id"))))
    return cache.withColumn("embedding", unit).withColumn("normalized", vectors.is_unit(F.col("embedding"), atol))


def fingerprint_rows(cache: DataFrame) -> DataFrame:
    """object_id and the hash of what identifies its row: the text's and the vector's hashes beside the origin."""
    parts = ["object_id", F.sha2("text", 256), "role", "model_id", "revision", "instruction_hash", "source_checksum", F.col("output_dim").cast("string"), F.col("normalized").cast("string"), vectors.checksum(F.col("embedding"))]
    return cache.select("object_id", F.sha2(F.concat_ws("|", *parts), 256).alias("row_hash"))


def write(cache: DataFrame, path: str, atol: float = 1e-3, overwrite: bool = False) -> dict:
    """Checks the cache, then writes it with a sidecar of its row count and fingerprint."""
    return tables.write_manifest(validation.validate_embedding_cache(cache, atol), path, overwrite)


def write_by_key(cache: DataFrame, path: str, atol: float = 1e-3, overwrite: bool = False, key: str = "object_id") -> dict:
    """write(), with rows in ranges of the key, sorted in each file, small row groups and a Bloom filter of keys in each.

    So a subset by keys reads few row groups, whether keys come in ranges or from anywhere.
    """
    sorted_rows = validation.validate_embedding_cache(cache, atol).repartitionByRange(key).sortWithinPartitions(key)
    options = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(GROUP_ROWS), "parquet.block.row.count.limit": str(GROUP_ROWS)}
    return tables.write_manifest(sorted_rows, path, overwrite, options)


def key_filter(ids: DataFrame, key: str) -> Column:
    """A filter that scans can push down and that all ids pass: each of a few, or the ranges that many lie in.

    Up to LISTED ids are named, TOGETHER in one list, as scans take longer lists for their range alone; of more only RANGES
    pairs of ends are gathered.
    """
    few = [r[0] for r in ids.select(key).distinct().limit(LISTED + 1).collect()]
    if not few:
        return F.lit(False)
    if len(few) <= LISTED:
        named = sorted(x for x in few if x is not None)
        parts = [F.col(key).isin(named[k : k + TOGETHER]) for k in range(0, len(named), TOGETHER)]
    else:
        ranges = ids.select(key).repartitionByRange(RANGES, key).groupBy(F.spark_partition_id()).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        parts = [F.col(key).between(r.lo, r.hi) for r in sorted(ranges, key=lambda r: (r.lo is None, r.lo)) if r.lo is not None]
    out = parts[0] if parts else F.lit(False)
    for p in parts[1:]:
        out = out | p
    return out


def subset(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Exactly the rows of the ids from a written cache; ids reach the scan as a filter. Missing and repeated ids raise."""
    rows = spark.read.parquet(path).where(key_filter(ids, "object_id"))
    return tables.select_ids(rows, ids, "object_id")


def lineage(spark: SparkSession, path: str) -> dict:
    """What was written beside a cache: its rows and print, and those of the cache that it was derived from, if any."""
    return spark.read.json(f"{path.rstrip('/')}.meta").first().asDict()


def derived(spark: SparkSession, source: str, path: str, make: Callable[[DataFrame], DataFrame], step: str, key: str = "object_id") -> dict:
    """A cache made row by row from a written one, kept with the print of its source; {"rows", "made", "kept"}.

    A derived cache whose source's print is unchanged is left as it is, and no vector is read. Otherwise rows of the same key and
    print of the source row are kept from it, and only the others are made. A source that doesn't match its own sidecar,
    and a derived cache made by another step, raise.
    """
    before = lineage(spark, source)
    there = _exists(spark, f"{path.rstrip('/')}.meta")
    old = lineage(spark, path) if there else None
    if old and old.get("step") != step:
        raise ValueError(f"{path} was made by {old.get('step')}, not by {step}")
    if old and (old["source_xor"], old["source_sum"]) == (before["xor_hash"], before["sum_hash"]):
        return {"rows": old["n_rows"], "made": 0, "kept": old["n_rows"]}
    rows = tables.verified(spark, source)
    prints = rows.join(fingerprint_rows(rows).select(key, F.col("row_hash").alias("source_row_hash")), key)
    if old:
        held = spark.read.parquet(path)
        same = staged(held.join(prints.select(key, "source_row_hash"), [key, "source_row_hash"], "left_semi"), "kept")
        fresh = prints.join(same.select(key), key, "left_anti")
    else:
        same, fresh = None, prints
    new = make(fresh.drop("source_row_hash")).join(fresh.select(key, "source_row_hash"), key)
    whole = staged(new if same is None else same.select(*new.columns).unionByName(new), "derived")
    whole.write.mode("overwrite").parquet(path)
    found = validation.fingerprint(spark.read.parquet(path)).withColumns({"step": F.lit(step), "source": F.lit(source), "source_xor": F.lit(before["xor_hash"]), "source_sum": F.lit(before["sum_hash"])})
    found.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.meta")
    n = whole.count()
    return {"rows": n, "made": n - (same.count() if same is not None else 0), "kept": same.count() if same is not None else 0}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
