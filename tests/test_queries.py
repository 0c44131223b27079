"""Every registered query of the graph library against its DuckDB twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestone.plans import registry
from lodestone.sources.projection import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
CHOSEN = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLES:
        return
    result = duck.execute(ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())


def test_twins_are_of_known_queries():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) > 0.9 * len(QUERIES)
