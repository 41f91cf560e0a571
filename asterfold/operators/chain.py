"""A chain of written tables that know what they were made from: fresh ones are kept, stale ones are made anew or refused."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.operators import caches, population, validation
from asterfold.sources import tables
from asterfold.sources.scratch import staged
from asterfold.streaming import generate

PRINT = "n_rows long, xor_hash long, sum_hash string"
SIDECAR = f"{PRINT}, version string, inputs array<struct<name: string, n_rows: long, xor_hash: long, sum_hash: string>>"


@dataclass(frozen=True)
class Stage:
    """A table made of others by name; another version of `make` makes what was written stale."""

    name: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    version: str = "1"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _sidecar(spark: SparkSession, root: str, name: str) -> dict | None:
    path = f"{root}/{name}.meta"
    row = spark.read.schema(SIDECAR).json(path).first() if _there(spark, path) else None
    return row.asDict(recursive=True) if row else None


def _known(prints: dict[str, dict], stage: Stage) -> list[dict]:
    return [{"name": n, **{k: prints[n][k] for k in ("n_rows", "xor_hash", "sum_hash")}} for n in stage.inputs]


def run_chain(spark: SparkSession, root: str, sources: dict[str, DataFrame], stages: Sequence[Stage]) -> dict[str, str]:
    """Makes each stage's table under root, in order, unless it is there from the same inputs and version: {name: made or kept}.

    Beside a table lie its own print and those of its inputs as it was made. A table enters with its sidecar last, so a stopped run
    goes on with the stage that it stopped in. A stage whose input is neither a source nor an earlier stage raises.
    """
    prints = {n: validation.fingerprint(df).first().asDict() for n, df in sources.items()}
    have, said = dict(sources), {}
    for stage in stages:
        if set(stage.inputs) - set(have):
            raise ValueError(f"{stage.name} needs {sorted(set(stage.inputs) - set(have))}")
        path, old = f"{root}/{stage.name}", _sidecar(spark, root, stage.name)
        wanted = _known(prints, stage)
        if old and old["version"] == stage.version and old["inputs"] == wanted:
            said[stage.name] = "kept"
        else:
            stage.make(*[have[n] for n in stage.inputs]).write.mode("overwrite").parquet(path)
            own = validation.fingerprint(spark.read.parquet(path))
            whole = F.array(*[F.struct(*[F.lit(x[k]).alias(k) for k in ("name", "n_rows", "xor_hash", "sum_hash")]) for x in wanted])
            own.withColumns({"version": F.lit(stage.version), "inputs": whole}).coalesce(1).write.mode("overwrite").json(f"{path}.meta")
            old, said[stage.name] = _sidecar(spark, root, stage.name), "made"
        prints[stage.name], have[stage.name] = old, spark.read.parquet(path)
    return said


def opened(spark: SparkSession, root: str, sources: dict[str, DataFrame], stages: Sequence[Stage], name: str) -> DataFrame:
    """A stage's table, if it and all that it was made from are what the sources give today, and its rows match its print; else raises."""
    prints = {n: validation.fingerprint(df).first().asDict() for n, df in sources.items()}
    for stage in stages:
        side = _sidecar(spark, root, stage.name)
        if side is None or side["version"] != stage.version or side["inputs"] != _known(prints, stage):
            raise ValueError(f"{stage.name} is stale or missing")
        prints[stage.name] = side
        if stage.name == name:
            df = spark.read.parquet(f"{root}/{name}")
            if validation.fingerprint(df).first().asDict() != {k: side[k] for k in ("n_rows", "xor_hash", "sum_hash")}:
                raise ValueError(f"{name} doesn't match its print")
            return df
    raise ValueError(f"no stage {name}")


def common_set_stages(captions: Callable[[DataFrame], DataFrame], encode: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int, model: str, revision: str, atol: float = 1e-3) -> list[Stage]:
    """Captions to a common set, and three caches over it: released vectors as they are, unit ones, and those of the captions.

    Sources: source (object_id, image, summary, vector) and manifest (object_id, ...). captions(source) gives object_id
    and description of what could be captioned. Each cache is checked, and has just the common objects.
    """

    def common(manifest: DataFrame, said: DataFrame) -> DataFrame:
        return manifest.join(validation.require_unique(said, "object_id").select("object_id"), "object_id", "left_semi")

    def shared(source: DataFrame, ids: DataFrame) -> DataFrame:
        return tables.select_ids(source, ids.select("object_id"), "object_id")

    def released(source: DataFrame, ids: DataFrame) -> DataFrame:
        return caches.ingest(shared(source, ids), "object_id", "summary", "vector", "released", revision, atol)

    def unit(cache: DataFrame) -> DataFrame:
        return validation.validate_embedding_cache(staged(caches.renormalized(cache, atol), "unit"), atol)

    def captioned(said: DataFrame, ids: DataFrame) -> DataFrame:
        rows = tables.select_ids(said, ids.select("object_id"), "object_id")
        vectors = generate.encoded(rows, "object_id", "description", encode, dim)
        cache = caches.ingest(rows.join(vectors, "object_id"), "object_id", "description", "embedding", model, revision, atol)
        return unit(cache)

    return [
        Stage("captions", ("source",), captions), Stage("common", ("manifest", "captions"), common), Stage("released", ("source", "common"), released),
        Stage("released_unit", ("released",), unit), Stage("captioned", ("captions", "common"), captioned)]


def aligned(*found: DataFrame, key: str = "object_id") -> int:
    """The number of keys, if all tables have just the same ones, once each; else raises."""
    for df in found[1:]:
        validation.same_keys(found[0], df, key)
    sizes = {validation.require_unique(df, key).count() for df in found}
    if len(sizes) != 1 or population.common_ids(*found, key=key).count() != min(sizes):
        raise ValueError(f"{key}: tables of {sorted(sizes)} rows")
    return sizes.pop()
