"""Tables on disk: Parquet, CSV and JSON lines in, Parquet with a fingerprint sidecar out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from asterfold.functions import text
from asterfold.operators import order, validation


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """Parquet by extension, else CSV with a header; only the named columns reach the scan.

    A CSV file without a schema has string columns: it is read once, and whoever needs numbers casts them.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = (spark.read.schema(schema) if schema else spark.read).csv(path, header=True)
    return validation.require_columns(df, columns).select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped; a missing path is an empty table if allowed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if missing_ok and not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def done_ids(spark: SparkSession, path: str, key: str = "object_id") -> DataFrame:
    return read_jsonl(spark, path, f"{key} string", True).distinct()


def query_rows(spark: SparkSession, queries: dict[str, list[str]]) -> DataFrame:
    """object_id category:index, variant canonical for the first text and paraphrase_i for the others."""
    rows = [(f"{c}:{i}", c, "canonical" if i == 0 else f"paraphrase_{i}", t) for c, texts in queries.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "object_id string, category string, variant string, text string")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_rows() of a file of JSON lines {"category", "texts"}; a category twice, or one without texts, raises."""
    rows = validation.require_unique(spark.read.schema("category string, texts array<string>").json(path), "category")
    rows = validation.require(rows, {"category without texts": F.col("category").isNull() | (F.coalesce(F.size("texts"), F.lit(0)) < 1)})
    each = rows.select("category", F.posexplode("texts").alias("i", "text"))
    variant = F.when(F.col("i") == 0, "canonical").otherwise(F.concat(F.lit("paraphrase_"), "i"))
    return each.select(F.concat_ws(":", "category", "i").alias("object_id"), "category", variant.alias("variant"), "text")


def select_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Exactly the rows of the ids: duplicates and missing ids raise."""
    found = validation.require_unique(df.join(ids.select(key), key, "left_semi"), key)
    missing = ids.join(df.select(key), key, "left_anti").limit(1).count()
    if missing:
        raise ValueError(f"ids without a row in {key}")
    return found


def first_present(df: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """One row of df whose key is a candidate; the scan stops at the first task that has one."""
    return df.join(candidates.select(key).distinct(), key, "left_semi").limit(1)


def indexed(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with each row's number from 0 along a numeric key; no single task holds all rows."""
    return order.ranked_along(df, [], [F.col(by)], name).withColumn(name, (F.col(name) - 1).cast("long"))


def read_cells(spark: SparkSession, root: str, cells: list[tuple[int, int]], columns: list[str], ids: DataFrame, key: str, kept: str) -> DataFrame:
    """The ids' rows of the named sky cells, read in one job and kept: a cell that the ledger beside the kept rows lists is not read again.

    Only the cells' folders and the named columns are scanned; cells enter the ledger once their rows are written.
    """
    ledger, rows = f"{kept}/ledger", f"{kept}/rows"
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    done = {tuple(r) for r in spark.read.schema("Norder int, Npix long").parquet(ledger).collect()} if there else set()
    todo = sorted(set(cells) - done)
    if todo:
        found = spark.read.option("basePath", root).parquet(*[f"{root}/{cell_path(*c)}" for c in todo]).select(*columns, "Norder", "Npix")
        found = found.join(ids.select(key).distinct(), key, "left_semi")
        found.repartition("Norder", "Npix").write.partitionBy("Norder", "Npix").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(rows)
        spark.createDataFrame(todo, "Norder int, Npix long").coalesce(1).write.mode("append").parquet(ledger)
    schema = spark.read.parquet(f"{root}/{cell_path(*cells[0])}").select(*columns).schema
    asked = F.struct(F.col("Norder").cast("int"), F.col("Npix").cast("long")).isin(*[F.struct(F.lit(o).cast("int"), F.lit(p).cast("long")) for o, p in cells])
    return spark.read.schema(schema.add("Norder", IntegerType()).add("Npix", LongType())).parquet(rows).where(asked).select(*columns)


def cell_path(order: int, pixel: int) -> str:
    """Folder of a sky cell: pixels in groups of ten thousand."""
    return f"Norder={order}/Dir={pixel // 10_000 * 10_000}/Npix={pixel}"


def write_manifest(df: DataFrame, path: str, overwrite: bool = False, options: dict[str, str] | None = None) -> dict:
    """Parquet that refuses to overwrite unless told, and a sidecar with its rows and fingerprint."""
    df.write.mode("overwrite" if overwrite else "errorifexists").options(**(options or {})).parquet(path)
    print_of = validation.fingerprint(df.sparkSession.read.parquet(path))
    print_of.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.meta")
    return print_of.first().asDict()


def write_evaluation(ranked: list[DataFrame], metrics: DataFrame, path: str) -> None:
    """Ranked rows of all runs as one Parquet table, their metrics beside it as JSON lines."""
    every = ranked[0]
    for other in ranked[1:]:
        every = every.unionByName(other)
    every.write.mode("errorifexists").parquet(f"{path}/ranked")
    metrics.coalesce(1).write.mode("errorifexists").json(f"{path}/metrics")


def write_audit(rows: DataFrame, metrics: DataFrame, path: str) -> None:
    """Audit rows as CSV with a header, their metrics beside it as JSON lines."""
    rows.write.mode("errorifexists").csv(f"{path}/rows", header=True)
    metrics.coalesce(1).write.mode("errorifexists").json(f"{path}/metrics")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """A written manifest whose fingerprint still holds."""
    df = spark.read.parquet(path)
    if validation.fingerprint(df).first() != spark.read.schema("n_rows long, xor_hash long, sum_hash string").json(f"{path.rstrip('/')}.meta").first():
        raise ValueError(f"{path} doesn't match its fingerprint")
    return df


def word_stats(df: DataFrame, text_col: str) -> DataFrame:
    """Mean, median and largest count of words; the median is exact and needs no single task."""
    n = df.select(text.word_count(F.col(text_col)).alias("n"))
    return n.agg(F.avg("n").alias("mean"), F.max("n").alias("max")).crossJoin(order.quantiles(n, [], "n", [0.5]).select(F.col("value").alias("median"))).select("mean", "median", "max")
