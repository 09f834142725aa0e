"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from bindwell.plans import registry

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].map(lambda v: None if v is pd.NaT else str(v)[:10]).astype(object)

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        try:
            return round(float(v), 6) if not isinstance(v, str) else v
        except TypeError:
            return str(v)

    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_sketches_are_close_to_exact_counts(spark):
    exact = {r["tac"]: r for r in registry.QUERIES["tac_population"](spark, SF).collect()}
    for r in registry.QUERIES["device_model_sketch"](spark, SF).collect():
        assert r["bindings"] == exact[r["tac"]]["bindings"]
        assert abs(r["handsets"] - exact[r["tac"]]["handsets"]) <= 0.03 * exact[r["tac"]]["handsets"] + 1
