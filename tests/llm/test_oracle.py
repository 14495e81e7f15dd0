"""The queries against their SQL on the small tables."""

import duckdb
import pytest

from skillcube.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    answer = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    columns = sorted(names)
    assert sorted(df.columns) == columns
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in answer.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
