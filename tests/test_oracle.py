"""Each registered query against its DuckDB text, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from graphloom.oracle import ORACLE
from graphloom.queries import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[str]:
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "-"
        return f"{v:.6f}" if isinstance(v, float) and v != int(v) else str(int(v)) if not isinstance(v, (str, bool)) and not hasattr(v, "year") else str(v)

    return sorted("|".join(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_parity(spark, sf_dir, duck, name):
    got, want = REGISTRY[name](spark, sf_dir).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
