"""Every registered query against its SQL, on the smallest given tables."""

import math
from pathlib import Path

import duckdb
import pytest

from panelspark.catalog import ORACLE_SQL, QUERIES

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def canonical(rows):
    def value(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return float(v) if isinstance(v, (int, float)) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, str(SF_DIR))
    result = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical(got.select(*columns).collect()) == canonical(result.fetchall())


def test_every_query_but_training_of_whole_models_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"cross_fit_gbt", "cross_fit_dart", "focal_boost", "null_sequence_stack", "recursive_selection", "cv_check"}
