import duckdb
import pandas as pd
import pytest

from turnlens.llm.queries import ORACLE, QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_gives_the_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    text = lambda x: str(x) if hasattr(x, "__len__") else "" if pd.isna(x) else str(int(x) if isinstance(x, float) and x.is_integer() else x)
    rows = lambda df: sorted(tuple(text(x) for x in r) for r in df[sorted(a.columns)].astype(object).to_numpy().tolist())
    assert rows(a) == rows(b)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
