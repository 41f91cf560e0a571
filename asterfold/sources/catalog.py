"""Catalogs on disk in sky cells: written with their leaves, opened, and read for targets, only the cells that hold them.

Layout: dataset/Norder=o/Dir=d/Npix=p, one folder a leaf, partition_info (a row a leaf) and properties (columns, schema).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from asterfold.operators import cells, validation
from asterfold.sources.scratch import staged

#: Cells that one job reads and keeps: what a killed run loses at most.
CELLS_A_JOB = 1_000
CELL = ["cell_order", "cell_pixel"]


@dataclass(frozen=True)
class Catalog:
    """rows: the columns with Norder, Dir, Npix; a filter on these prunes folders. info: cell_order, cell_pixel, n_rows."""

    path: str
    rows: DataFrame
    info: DataFrame
    ra: str
    dec: str
    key: str


def write_catalog(df: DataFrame, path: str, key: str, ra: str, dec: str, coarse: int, fine: int, most: int) -> Catalog:
    """df in leaves of at most `most` rows where the finer order can give them; an existing path raises.

    Rows of a leaf are sorted by key. Rows without a place raise.
    """
    rows = validation.require(df, {"no place": F.col(ra).isNull() | F.col(dec).isNull()})
    leaves = staged(cells.adaptive_leaves(rows, F.col(ra), F.col(dec), coarse, fine, most), "leaves")
    placed = cells.assign_leaves(rows, leaves, ra, dec)
    named = placed.select(*df.columns, F.col("cell_order").alias("Norder"), (F.floor(F.col("cell_pixel") / 10_000) * 10_000).cast("long").alias("Dir"), F.col("cell_pixel").alias("Npix"))
    named.repartition("Norder", "Npix").sortWithinPartitions("Norder", "Npix", key).write.partitionBy("Norder", "Dir", "Npix").parquet(f"{path}/dataset")
    written = df.sparkSession.read.schema(named.schema).parquet(f"{path}/dataset")
    written.groupBy(F.col("Norder").alias("cell_order"), F.col("Npix").alias("cell_pixel")).agg(F.count("*").alias("n_rows")).coalesce(1).write.parquet(f"{path}/partition_info")
    said = json.dumps({"key": key, "ra": ra, "dec": dec, "schema": named.schema.jsonValue()})
    df.sparkSession.createDataFrame([(said,)], "properties string").coalesce(1).write.text(f"{path}/properties")
    return open_catalog(df.sparkSession, path)


def open_catalog(spark: SparkSession, path: str) -> Catalog:
    """A written catalog; no data file is opened for it."""
    said = json.loads(spark.read.text(f"{path}/properties").first()[0])
    info = spark.read.schema("cell_order int, cell_pixel long, n_rows long").parquet(f"{path}/partition_info")
    rows = spark.read.schema(StructType.fromJson(said["schema"])).parquet(f"{path}/dataset")
    return Catalog(path, rows, info, said["ra"], said["dec"], said["key"])


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def asked_cells(catalog: Catalog, targets: DataFrame, key: str, ra: str, dec: str) -> tuple[DataFrame, DataFrame]:
    """(targets with their leaf, the leaves asked for with a count and an order-free hash of the ids asked for there)."""
    placed = staged(cells.assign_leaves(validation.require_unique(targets, key).select(key, ra, dec), catalog.info, ra, dec), "targets")
    asked = placed.groupBy(*CELL).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(key)).alias("ids_xor"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).cast("string").alias("ids_sum"))
    return placed, staged(asked, "asked")


def pruned(catalog: Catalog, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns and the leaf of all rows in the wanted cells (cell_order, cell_pixel, n); other folders are skipped at run time."""
    few = F.broadcast(wanted.where("n > 0").select(F.col("cell_order").alias("Norder"), F.col("cell_pixel").alias("Npix")))
    return catalog.rows.join(few, ["Norder", "Npix"]).select(*columns, F.col("Norder").alias("cell_order"), F.col("Npix").alias("cell_pixel"))


def read_targets(catalog: Catalog, targets: DataFrame, key: str, ra: str, dec: str, columns: list[str], kept: str) -> DataFrame:
    """The targets' rows of a catalog, each once, read from their leaves only and kept.

    A ledger beside the kept rows lists the leaves that are done, with a hash of the ids asked for: such a leaf isn't
    read again, one asked for other ids is. Leaves are read CELLS_A_JOB a job, and a job's leaves enter the ledger once its rows are
    written, so a killed run goes on where it stopped. A target that its leaf lacks, or has twice, raises.
    """
    spark, mine = catalog.rows.sparkSession, [*dict.fromkeys([catalog.key, *columns])]
    placed, asked = asked_cells(catalog, targets, key, ra, dec)
    ledger, rows, shape = f"{kept}/ledger", f"{kept}/rows", asked.schema
    done = spark.read.schema(shape).parquet(ledger) if _there(spark, ledger) else spark.createDataFrame([], shape)
    todo = asked.join(done, [*CELL, "n", "ids_xor", "ids_sum"], "left_anti")
    todo = staged(todo.withColumn("job", F.pmod(F.xxhash64(*CELL), F.lit(max(1, -(-todo.count() // CELLS_A_JOB))))), "todo")
    for job in sorted(r.job for r in todo.select("job").distinct().collect()):
        now = todo.where(F.col("job") == job)
        ids = placed.join(F.broadcast(now.select(*CELL)), CELL, "left_semi").select(F.col(key).alias(catalog.key))
        found = pruned(catalog, now, mine).join(ids, catalog.key, "left_semi")
        found.repartition(*CELL).write.partitionBy(*CELL).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(rows)
        now.select(*asked.columns).coalesce(1).write.mode("append").parquet(ledger)
    schema = StructType([*(catalog.rows.schema[c] for c in mine), *(asked.schema[c] for c in CELL)])
    out = spark.read.schema(schema).parquet(rows) if _there(spark, rows) else spark.createDataFrame([], schema)
    out = out.join(placed.select(F.col(key).alias(catalog.key), *CELL), [catalog.key, *CELL], "left_semi")
    whole = placed.select(F.col(key).alias("k")).join(out.groupBy(F.col(catalog.key).alias("k")).agg(F.count("*").alias("n")), "k", "left")
    validation.require(whole, {"targets not found": F.col("n").isNull(), "targets found twice": F.col("n") > 1})
    return out.select(*mine)

