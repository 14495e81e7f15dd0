"""Every query against its SQL on the small tables."""

import duckdb
import pytest

from skillcube.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, sf, sql, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    answer = sql.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in answer.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x)) for x, y in zip(a, b, strict=True))


def test_probabilistic_climatology_has_all_target_times(spark, sf):
    out = catalog.QUERIES["prob_climatology"](spark, sf)
    ser = catalog.cubes.series(spark, sf)
    assert out.select("time", "latitude").distinct().count() == ser.select("time", "latitude").distinct().count()
    assert out.selectExpr("left(time, 4) AS y").distinct().count() == ser.selectExpr("year(time) AS y").distinct().count() > 1
