"""Every query of the catalogue against its SQL, row by row; those without SQL have a test of their own elsewhere."""

import duckdb
import pytest

from manyview.plans import relations as queries

SF = "/root/testdata/sf0.001"
TABLES = ["nation", "part", "lineitem", "embeddings"]
SPARK_TO_SQL = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    expected = sql.execute(queries.ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in expected.description}
    at = [[d[0] for d in expected.description].index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=repr)
    assert {c: SPARK_TO_SQL[k] for c, k in df.dtypes} == kinds
    assert got


def test_entry_names_agree():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
