"""Resumable generation: each key once, errors to a table of their own, a budget that stops the run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from asterfold.operators import order, validation

#: Parts in which a run is generated; the error budget is looked at after each.
WAVES = 8


def generated(rows: DataFrame, key: str, text_col: str, make: Callable[[str], str], parse: Callable[[str], str] | None = None) -> DataFrame:
    """key, response, error: a failing or empty response is an error row, never a failed task.

    parse turns a good response into what is kept; a response that it refuses is an error row, too.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[text_col], strict=True):
                try:
                    answer = make(t)
                    if not answer or not answer.strip():
                        out.append((k, None, "empty response"))
                    else:
                        out.append((k, parse(answer) if parse else answer, None))
                except Exception as e:
                    out.append((k, None, repr(e)))
            yield pd.DataFrame(out, columns=[key, "response", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text_col).mapInPandas(run, f"{key} {kind}, response string, error string")


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _known(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for p in paths:
        if _there(spark, p):
            out = out.unionByName(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(p))
    return out


def _split(spark: SparkSession, results: DataFrame, schema: str, pending: str, good: str, bad: str, mode: str) -> None:
    """Generates once, into `pending`, and copies from there: a lost executor cannot make a key both good and bad."""
    results.write.mode("overwrite").parquet(pending)
    written = spark.read.schema(schema).parquet(pending)
    written.where("error is null").write.mode(mode).parquet(good)
    written.where("error is not null").write.mode(mode).parquet(bad)


def append_results(spark: SparkSession, rows: DataFrame, key: str, text_col: str, make: Callable[[str], str], good: str, bad: str, error_rate: float, parse: Callable[[str], str] | None = None) -> dict:
    """Generates for the keys that neither table has, in waves; raises as soon as errors exceed floor(n * rate).

    Repeated keys raise, as do done keys that the rows lack or that both tables hold.
    """
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, response string, error string"
    validation.require_unique(rows, key)
    validation.resume_sets(rows, _known(spark, schema, good), _known(spark, schema, bad), key)
    n, allowed = rows.count(), int(rows.count() * error_rate)
    todo = rows.join(_known(spark, schema, good, bad).select(key), key, "left_anti").withColumn("__wave", F.pmod(F.xxhash64(key), F.lit(WAVES)))
    waves = [r["__wave"] for r in todo.select("__wave").distinct().orderBy("__wave").collect()]
    for wave in [None, *waves]:  # errors of earlier runs count before anything is made
        if wave is not None:
            part = rows.join(todo.where(F.col("__wave") == wave).select(key), key, "left_semi")
            _split(spark, generated(part, key, text_col, make, parse), schema, f"{good.rstrip('/')}.pending", good, bad, "append")
        errors = _known(spark, schema, bad).count()
        if errors > allowed:
            raise RuntimeError(f"{errors} errors, {allowed} allowed")
    return statistics(n, _known(spark, schema, good), _known(spark, schema, bad))


def statistics(n: int, good: DataFrame, bad: DataFrame) -> dict:
    completed, errors = good.count(), bad.count()
    return {"completed": completed, "errors": errors, "pending": n - errors - completed}


def marked_keys(source: DataFrame, key: str, text_col: str) -> DataFrame:
    """A stream's key and text once a batch and key, with known (an earlier batch had the key) and repeated (known, or twice here).

    The state store of the query's checkpoint is the ledger of keys: a bit a key, dealt by the key's hash, so a batch looks up its own
    keys only, whatever came before.
    """
    kind = source.schema[key].dataType.simpleString()

    def mark(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, text, known = 0, None, state.exists
        for frame in frames:
            texts = frame[text_col].dropna()
            rows, text = rows + len(frame), min([*texts, *([] if text is None else [text])], default=None)
        if not known:
            state.update((True,))
        yield pd.DataFrame({key: [k[0]], text_col: [text], "known": [known], "repeated": [known or rows > 1]})

    return source.groupBy(key).applyInPandasWithState(mark, f"{key} {kind}, {text_col} string, known boolean, repeated boolean", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def _errors_so_far(spark: SparkSession, path: str, n: int, own: int) -> int:
    """Errors of all batches up to n: a batch writes its total, which the next one alone reads, and a repeated one replaces."""
    before = f"{path}/batch={n - 1}"
    total = own + (spark.read.schema("errors long").parquet(before).first().errors if n and _there(spark, before) else 0)
    spark.createDataFrame([(total,)], "errors long").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={n}")
    return total


def stream_results(source: DataFrame, key: str, text_col: str, make: Callable[[str], str], good: str, bad: str, checkpoint: str, errors_allowed: int | None = None, repeats: str = "skip"):
    """The same from a stream. Batches are written by id, so that a repeated batch replaces itself.

    Keys that an earlier batch held are skipped, or raise with repeats="raise", as do keys twice in a batch; of several texts the least
    counts. A batch reads neither earlier results nor their keys: see marked_keys(). More than errors_allowed errors in
    all stop the stream. One checkpoint belongs to one pair of tables.
    """
    schema = f"{key} {source.schema[key].dataType.simpleString()}, response string, error string, batch long"

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # else the state would be looked up once for each use
        try:
            if repeats == "raise" and batch.where("repeated").limit(1).count():
                raise ValueError(f"{key} occurs on both sides: in this batch and before, or twice in it")
            results = generated(batch.where("not known"), key, text_col, make).withColumn("batch", F.lit(n).cast("long"))
            _split(spark, results, schema, f"{good.rstrip('/')}.pending", f"{good}/part={n}", f"{bad}/part={n}", "overwrite")
        finally:
            batch.unpersist()
        own = spark.read.schema(schema).parquet(f"{bad}/part={n}").count()
        errors = _errors_so_far(spark, f"{bad.rstrip('/')}.totals", n, own)
        if errors_allowed is not None and errors > errors_allowed:
            raise RuntimeError(f"{errors} errors, {errors_allowed} allowed")

    return marked_keys(source, key, text_col).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def encoded(rows: DataFrame, key: str, text_col: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int, batch: int = 64) -> DataFrame:
    """key, embedding: texts through an encoder that each task loads once, `batch` at a time; another length than dim raises."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for frame in frames:
            texts, out = frame[text_col].tolist(), []
            for low in range(0, len(texts), batch):
                out += [[float(x) for x in v] for v in encode(texts[low : low + batch])]
            if len(out) != len(texts) or any(len(v) != dim for v in out):
                raise ValueError(f"the encoder must give {dim} numbers a text")
            yield pd.DataFrame({key: frame[key], "embedding": out})

    return rows.select(key, text_col).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def running_cost(usage: DataFrame, along: str, cost: str, cap: float) -> DataFrame:
    """Cumulative cost per provider along a column, flagged from where it passes the cap."""
    total = order.running_sum(usage, ["provider"], along, cost, "running")
    return total.withColumn("running", F.round("running", 6)).withColumn("over_cap", F.col("running") > cap)
