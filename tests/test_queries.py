"""Every registered query against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from strataform.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as from '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        return "~" if v is None or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, con, name):
    assert rows(registry.QUERIES[name](spark, str(DATA)).toPandas()) == rows(con.sql(registry.ORACLE_SQL[name]).df())
