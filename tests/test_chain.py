"""A chain of tables: what is kept, what is made anew, what is refused."""

import pytest
from pyspark.sql import functions as F

from asterfold.operators import chain, validation


def parts(spark):
    source = spark.createDataFrame([(str(k), f"i{k}" if k % 4 else "", f"s{k}", [3.0, 4.0 + k]) for k in range(20)], "object_id string, image string, summary string, vector array<double>")
    calls = []

    def captions(rows):
        calls.append("captions")
        return rows.where("image <> ''").select("object_id", F.concat(F.lit("a "), "image").alias("description"))

    stages = chain.common_set_stages(captions, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2, "m", "r")
    return source, source.select("object_id", F.lit(1).alias("x")), stages, calls


def test_chain_keeps_what_is_fresh(spark, tmp_path):
    source, manifest, stages, calls = parts(spark)
    run = lambda s=source, m=manifest, st=stages: chain.run_chain(spark, f"{tmp_path}", {"source": s, "manifest": m}, st)
    assert set(run().values()) == {"made"} and set(run().values()) == {"kept"} and calls == ["captions"]
    get = lambda name, s=source: chain.opened(spark, f"{tmp_path}", {"source": s, "manifest": manifest}, stages, name)
    assert chain.aligned(*[get(s.name) for s in stages[1:]]) == 15
    assert get("released_unit").where("normalized").count() == 15 and get("released").where("normalized").count() == 0
    assert {r.object_id: r.text for r in get("captioned").collect()}["1"] == "a i1"
    # a changed summary reaches the released caches, the captions' cache stays
    changed = source.withColumn("summary", F.concat("summary", F.lit("!")))
    with pytest.raises(ValueError, match="captions is stale"):
        get("released", changed)
    assert run(changed) == {"captions": "made", "common": "kept", "released": "made", "released_unit": "made", "captioned": "kept"}
    other = [*stages[:-1], chain.Stage("captioned", stages[-1].inputs, stages[-1].make, "2")]
    assert run(changed, manifest, other)["captioned"] == "made"


def test_a_stopped_chain_goes_on(spark, tmp_path):
    source, manifest, stages, calls = parts(spark)

    def fails(*_):
        raise RuntimeError("stopped")

    broken = [*stages[:3], chain.Stage("released_unit", ("released",), fails), stages[4]]
    with pytest.raises(RuntimeError):
        chain.run_chain(spark, f"{tmp_path}", {"source": source, "manifest": manifest}, broken)
    said = chain.run_chain(spark, f"{tmp_path}", {"source": source, "manifest": manifest}, stages)
    assert said == {"captions": "kept", "common": "kept", "released": "kept", "released_unit": "made", "captioned": "made"} and calls == ["captions"]


def test_damage_and_gaps_are_refused(spark, tmp_path):
    source, manifest, stages, _ = parts(spark)
    sources = {"source": source, "manifest": manifest}
    with pytest.raises(ValueError, match="needs"):
        chain.run_chain(spark, f"{tmp_path}", {"source": source}, stages)
    chain.run_chain(spark, f"{tmp_path}", sources, stages)
    spark.read.parquet(f"{tmp_path}/common").limit(3).write.parquet(f"{tmp_path}/less")
    spark.read.parquet(f"{tmp_path}/less").write.mode("overwrite").parquet(f"{tmp_path}/common")
    with pytest.raises(ValueError, match="print"):
        chain.opened(spark, f"{tmp_path}", sources, stages, "common")
    with pytest.raises(ValueError, match="differ"):
        chain.aligned(source, source.limit(2))
    assert validation.fingerprint(source).first().n_rows == 20
