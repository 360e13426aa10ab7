"""Each registered query of the engine against its SQL on an independent engine."""

import math
import os

import duckdb
import pytest

from lexarc.plans import catalog


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.fixture(scope="module")
def run(spark, sf):
    from lexarc.plans.pipeline import Transcripts

    t = Transcripts.of(spark, sf)
    t.documents = spark.read.parquet(f"{sf}/documents.parquet")
    return t


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, run, con):
    df = catalog.REGISTRY[name][0](run)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert got == want
