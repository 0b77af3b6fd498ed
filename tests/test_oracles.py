"""Every query with an oracle, on the smallest tables."""

import os

import duckdb
import pytest

from codeloom.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def normal(df, columns):
    def cell(v):
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else repr(round(v, 9))
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert normal(got, columns) == normal(want, columns)


def test_breaker_replay_has_every_call(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    got = registry.QUERIES["breaker_state"](spark, DATA)
    assert got.count() == events.count()
