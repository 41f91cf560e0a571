"""A corpus pipeline: each stage calls one operator and is written as Parquet before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.llm import decontam, langid, packing, secrets, simhash
from asterfold.llm.common import release, staged, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the classifier rejects: null and empty texts, texts without a letter, narrow margins.

    Null ids, shared ids and repeated rows are judged by their own text. Ties of size don't count as accepted. An
    empty table stays empty; other columns pass through.
    """
    return langid.keep_accepted(docs, langid.learn_dictionaries(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component, that of the smallest doc_id, null ids last.

    Null and empty texts have fingerprint zero and link like any other; rows alike in all columns stay once. Ties of id
    go by the hash of the text, then of all columns. An empty table stays empty.
    """
    return simhash.distinct_documents(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none and stay; each row goes by its own text, whatever its id. Null items and an empty
    benchmark drop nothing; other columns pass through.
    """
    return decontam.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars, where docs has it, follows where a text changes.

    No row is dropped: null and empty texts stay as they are, rows that share an id are masked by their own text, and
    rows that repeat each other are masked alike. Null sources count as one owner. An empty table stays empty.
    """
    masked = secrets.mask_secrets(docs.withColumn("__before", F.xxhash64("text")))
    if "n_chars" in docs.columns:
        changed = F.xxhash64("text") != F.col("__before")
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens: one row a piece.

    Null and empty texts are one piece of the end id; null ids and repeated rows are packed like any other; an empty
    table gives no rows.
    """
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secret_spans), ("packing", pack)]

#: Compression, fingerprints and packing have no SQL form; the query is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
