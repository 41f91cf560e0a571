"""Checks that raise: each is one aggregate, not a collected table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterfold.functions import vectors

CACHE_COLUMNS = ("object_id", "text", "embedding", "role", "model_id", "revision", "instruction", "instruction_hash", "source_checksum", "output_dim", "normalized")


def require_columns(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_rows(df: DataFrame, n: int, **counts: tuple[Column, int]) -> DataFrame:
    """df, if it has n rows, and as many rows of each named condition as given; one aggregate."""
    row = df.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, (c, _) in counts.items()]).first().asDict()
    wrong = {k: (row[k], wanted) for k, wanted in {"rows": n, **{k: w for k, (_, w) in counts.items()}}.items() if row[k] != wanted}
    if wrong:
        raise ValueError(f"counts found and expected: {wrong}")
    return df


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    first = duplicates(df, *keys).orderBy(*keys).first()
    if first:
        raise ValueError(f"duplicate key: {first.asDict()}")
    return df


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: how many rows break each rule (a true column is a breach)."""
    return df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    broken = {k: n for k, n in violations(df, rules).first().asDict().items() if n}
    if broken:
        raise ValueError(f"rows break {broken}")
    return df


def no_leakage(manifest: DataFrame) -> DataFrame:
    return require(manifest, {"excluded row in a split": F.col("benchmark_exclusion") & F.col("split").isin("train", "validation")})


def no_overlap(a: DataFrame, b: DataFrame, key: str) -> None:
    if a.join(b, key, "left_semi").limit(1).count():
        raise ValueError(f"{key} occurs on both sides")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raises where one side has a key that the other lacks; one join."""
    left, right = a.select(key).distinct().withColumn("__l", F.lit(1)), b.select(key).distinct().withColumn("__r", F.lit(1))
    if left.join(right, key, "full_outer").where("__l is null or __r is null").limit(1).count():
        raise ValueError(f"{key} sets differ")


def resume_sets(expected: DataFrame, good: DataFrame, bad: DataFrame, key: str) -> None:
    """A run may go on if no key is both done and failed, and if all done or failed keys are expected."""
    no_overlap(good, bad, key)
    if good.select(key).unionByName(bad.select(key)).join(expected.select(key), key, "left_anti").limit(1).count():
        raise ValueError(f"{key} is done but not expected")


def coverage(found: DataFrame, expected: int) -> DataFrame:
    """Coverage rows: as many as expected, each matched or absent, matched ones with a source."""
    rules = {"state": ~F.coalesce(F.col("status").isin("matched", "absent"), F.lit(False)), "matched without a source": (F.col("status") == "matched") & (F.coalesce(F.col("source_object_id").cast("string"), F.lit("")) == "")}
    row = found.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()]).first()
    broken = {k: row[k] for k in rules if row[k]} | ({"rows": row.n} if row.n != expected else {})
    if broken:
        raise ValueError(f"coverage breaks {broken}, {expected} rows expected")
    return found


def same_target(df: DataFrame, graded: Column, threshold: float, binary: Column) -> DataFrame:
    """A graded target reaches the threshold exactly where the binary one holds."""
    return require(df, {"graded and binary targets differ": ~(graded >= threshold).eqNullSafe(binary)})


def expected_positives(df: DataFrame, by: str, relevant: Column, expected: dict[str, int]) -> DataFrame:
    """df, if each named group has as many relevant rows as expected."""
    got = {r[by]: r.n for r in df.where(F.col(by).isin(*expected)).groupBy(by).agg(F.count_if(relevant).alias("n")).collect()}
    wrong = {k: got.get(k, 0) for k, n in expected.items() if got.get(k, 0) != n}
    if wrong:
        raise ValueError(f"positives {wrong}, expected {expected}")
    return df


def held_out_predictions(predictions: DataFrame, splits: DataFrame, key: str, condition: str, seed: str) -> DataFrame:
    """predictions, if each condition has exactly each seed's test keys, once. splits: key, seed, split."""
    test = splits.where("split = 'test'").select(key, seed)
    wanted = test.crossJoin(F.broadcast(predictions.select(condition).distinct())).withColumn("__want", F.lit(1))  # a few conditions
    per = predictions.groupBy(key, seed, condition).agg(F.count("*").alias("__n"))
    both = per.join(wanted, [key, seed, condition], "full_outer")
    require(both, {"missing": F.col("__n").isNull(), "not held out": F.col("__want").isNull(), "repeated": F.col("__n") > 1})
    return predictions


def paired(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with a side column (both, left_only, right_only)."""
    a, b = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return a.join(b, keys, "full_outer").withColumn("side", side).drop("__l", "__r")


def one_to_one_left(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Left join validated 1:1: unique keys on both sides, no row without its right value."""
    require_unique(left, key)
    require_unique(right, key)
    joined = left.join(right, key, "left")
    return require(joined, {f"no {value}": F.col(value).isNull()})


def embedding_cache_rules(atol: float = 1e-3) -> dict[str, Column]:
    document = F.col("role") == "document"
    return {
        "role": ~F.col("role").isin("document", "query") | F.col("role").isNull(),
        "instructed document": document & (F.coalesce("instruction", F.lit("")) != ""),
        "dimension": F.size("embedding") != F.col("output_dim"),
        "normalized flag": F.col("normalized") != vectors.is_unit(F.col("embedding"), atol),
        "not normalized": ~vectors.is_unit(F.col("embedding"), atol),
        "instruction hash": F.col("instruction_hash") != F.sha2(F.coalesce("instruction", F.lit("")), 256),
    }


def validate_embedding_cache(df: DataFrame, atol: float = 1e-3) -> DataFrame:
    require_unique(require_columns(df, CACHE_COLUMNS), "object_id")
    return require(df, embedding_cache_rules(atol))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that doesn't depend on row order: the row count, and sum and xor of 60 bits of each row's SHA-256 as JSON."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor("h"), F.lit(0).cast("long")).alias("xor_hash"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum_hash"))


def gate(df: DataFrame, name: str, value: Column, targets: dict[str, float], digits: int = 3) -> DataFrame:
    """Each named metric's value, its target, and whether they agree to so many digits; a target without a metric is not passed."""
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(v)).alias("target")) for k, v in targets.items()])).alias("w")
    every = df.sparkSession.range(1).select(wanted).select("w.*")
    got = df.select(F.col(name).alias("name"), F.round(value, digits).alias("value"))
    return every.join(got, "name", "left").withColumn("passed", F.coalesce(F.abs(F.col("value") - F.col("target")) < 10.0 ** -(digits + 2), F.lit(False)))
