"""Each registered query against its SQL on the smallest tables."""

import os

import pytest

from asterfold.plans import comparisons, models, prechecks, readouts, storage  # noqa: F401
from asterfold.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


def canon(rows, names):
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(SQL))
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{D}/{f}')")
    want = c.execute(SQL[name])
    columns = [x[0] for x in want.description]
    got = QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(columns)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), columns)


def test_library_stands_without_the_corpus_operators():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "asterfold"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "asterfold.llm" in p.read_text()]
