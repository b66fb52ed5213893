import glob
import math
import numbers
import os

import duckdb
import pytest

from tracewell.queries import lineage, relational

DATA = "/root/testdata/sf0.001"

NAMES = list({**relational.ORACLE, **lineage.ORACLE})


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, numbers.Number):
        return "nan" if math.isnan(value) else round(float(value), 5)
    return str(value)


@pytest.fixture(scope="module")
def other():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, other, name):
    run = {**relational.QUERIES, **lineage.QUERIES}[name]
    found = run(spark, DATA)
    columns = sorted(found.columns)
    expected = other.execute({**relational.ORACLE, **lineage.ORACLE}[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    rows = sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in expected.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in found.collect()) == rows
