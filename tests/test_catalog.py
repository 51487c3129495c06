import os

import duckdb
import pandas as pd
import pytest

from quillgraph.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame: pd.DataFrame) -> list[tuple]:
    """Rows in a form that both engines give alike, in order of their values."""
    def value(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return ""
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        return f"{v:.6f}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(value(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalog.queries())
def test_query_matches_its_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
