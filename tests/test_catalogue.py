"""Every registered raster query against the same text in DuckDB, over the smallest tables."""

import duckdb
import pytest

from lamina.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(frame, columns):
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_in_both_engines(spark, duck, sf_dir, name):
    theirs = duck.execute(catalogue.oracle_sql()[name]).df()
    ours = catalogue.queries()[name](spark, sf_dir).toPandas()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    assert rows(ours, columns) == rows(theirs, columns)


@pytest.mark.parametrize("name", sorted(catalogue.KERNELS))
def test_kernels_keep_all_places(spark, sf_dir, name):
    got = catalogue.queries()[name](spark, sf_dir)
    assert got.count() == 500 * 64 and got.filter("v IS NULL OR isnan(v)").count() == 0
