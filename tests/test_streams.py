"""A stream's ledger of keys: restarts, repeats within and across batches, and what a batch reads."""

import json
import os

import pytest

from asterfold.streaming import generate


def feed(folder, n, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{n:03d}.json", "w") as out:
        out.writelines(json.dumps({"k": k, "t": t}) + "\n" for k, t in rows)
    os.utime(f"{folder}/{n:03d}.json", (1_700_000_000 + n,) * 2)  # files are read by age


def run(spark, at, make=lambda t: t.upper(), **options):
    source = spark.readStream.schema("k int, t string").option("maxFilesPerTrigger", 1).json(f"{at}/in")
    query = generate.stream_results(source, "k", "t", make, f"{at}/good", f"{at}/bad", f"{at}/check", **options)
    query.awaitTermination()


def results(spark, at, table="good"):
    return sorted((r.k, r.response, r.batch) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/{table}").collect())


def test_keys_are_made_once_over_restarts(spark, tmp_path):
    at, calls = str(tmp_path), f"{tmp_path}/calls"

    def make(t):
        with open(calls, "a") as out:
            out.write(t + "\n")
        return t.upper()

    feed(f"{at}/in", 0, [(1, "a"), (2, "b"), (2, "a b")])
    run(spark, at, make)
    feed(f"{at}/in", 1, [(2, "again"), (3, "c")])
    feed(f"{at}/in", 2, [(1, "again"), (3, "again"), (4, None)])
    run(spark, at, make)
    assert results(spark, at) == [(1, "A", 0), (2, "A B", 0), (3, "C", 1)] and [r[0] for r in results(spark, at, "bad")] == [4]
    assert sorted(open(calls).read().split("\n")) == ["", "a", "a b", "c"]


def test_a_batch_does_not_read_earlier_results(spark, tmp_path):
    at = str(tmp_path)
    feed(f"{at}/in", 0, [(k, f"t{k}") for k in range(20)])
    run(spark, at)
    for folder, _, files in os.walk(f"{at}/good"):  # earlier results can't be read any more
        for f in files:
            if f.endswith(".parquet"):
                with open(f"{folder}/{f}", "wb") as out:
                    out.write(b"damaged")
    feed(f"{at}/in", 1, [(5, "again"), (30, "new")])
    run(spark, at)
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{at}/good/part=1").collect()] == [(30, "NEW")]


def test_a_failed_batch_is_repeated_whole(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    feed(f"{at}/in", 0, [(1, "a"), (2, "b")])
    real = generate._errors_so_far

    def stop(*_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(generate, "_errors_so_far", stop)  # after the results of the batch are written
    with pytest.raises(Exception, match="stopped"):
        run(spark, at)
    monkeypatch.setattr(generate, "_errors_so_far", real)
    feed(f"{at}/in", 1, [(2, "again")])
    run(spark, at)
    assert results(spark, at) == [(1, "A", 0), (2, "B", 0)]


def test_errors_add_up_over_batches(spark, tmp_path):
    at = str(tmp_path)
    for n in range(3):
        feed(f"{at}/in", n, [(n, "")])
    with pytest.raises(Exception, match="3 errors, 2 allowed"):
        run(spark, at, errors_allowed=2)


@pytest.mark.parametrize("rows", [[(1, "a"), (1, "b")], [(0, "again")]])
def test_repeats_raise_if_asked(spark, tmp_path, rows):
    at = str(tmp_path)
    feed(f"{at}/in", 0, [(0, "x")])
    feed(f"{at}/in", 1, rows)
    with pytest.raises(Exception, match="both sides"):
        run(spark, at, repeats="raise")
