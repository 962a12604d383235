"""Every query of this subpackage that has SQL, against it in DuckDB."""

import shutil
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from strataform.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

_LINE = "Same, LINE 7 of the house"
_SPAN = " ".join(f"w{i}" for i in range(30))
ODD = [
    (1, "a", None),
    (2, "a", ""),
    (3, "a", f"{_LINE}\nx # y $\n\n \t\n{_LINE}"),
    (4, "a", f"same, line 8  of the house\n{_SPAN}\nend"),
    (5, "a", f"same, line 9 of the house\n{_SPAN} {_SPAN}"),
    (6, "a", "SAME, line 0 of the house\nä b ä b ä b ä"),
    (7, None, "no host\n" + "z " * 60),
    (8, None, "no host\n" + " ".join(f"é{i}" for i in range(55))),
    (9, None, "no  Host\n" + " ".join(f"q{i}" for i in range(55))),
    (10, None, "no host\n" + " ".join(f"r{i}" for i in range(55))),
    (11, "b", " ".join("Ü" * k + "x" * j for k in range(1, 40, 6) for j in range(9))),
    (12, "b", "one two"),
    (13, "b", "ONE\ttwo"),
    (14, "b", "one"),
]


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        return "~" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module", params=["tables", "odd rows"])
def folder(request, tmp_path_factory):
    if request.param == "tables":
        return DATA
    out = tmp_path_factory.mktemp("odd")
    for p in DATA.glob("*.parquet"):
        shutil.copy(p, out / p.name)
    (out / "documents.parquet").chmod(0o644)
    pd.DataFrame(ODD, columns=["doc_id", "source", "text"]).to_parquet(out / "documents.parquet")
    return out


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, folder, name):
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.sql(f"create view {p.stem} as from '{p}'")
    assert rows(queries.QUERIES[name](spark, str(folder)).toPandas()) == rows(con.sql(queries.ORACLE_SQL[name]).df())
