"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from loomgraph.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()
NAMES = [n for n in catalog.oracle_sql() if n not in ("ga01_god_nodes", "ga01_pagerank", "ga03_related", "join14_neighbourhood")]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(map(tuple, pdf[cols].astype(object).where(pdf[cols].notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, con, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(con.sql(catalog.oracle_sql()[name]).df())
