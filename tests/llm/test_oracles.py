import duckdb
import pytest

from corpusloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    expected = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    key = list(got.columns[:3])
    a, b = (x.sort_values(key).reset_index(drop=True)[sorted(x.columns)] for x in (got, expected))
    assert (a == b).all().all()
