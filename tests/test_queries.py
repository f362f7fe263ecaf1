"""Every query with a SQL twin against DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from stacklight.plans.queries import ORACLE_SQL, QUERIES

TABLES = ("part", "documents", "embeddings")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def rows(d: pd.DataFrame) -> list:
    value = lambda x: "" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(value, r)) for r in d[sorted(d.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
