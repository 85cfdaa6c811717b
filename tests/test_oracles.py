"""Each registered query against its SQL on the smallest tables."""

import math
import os

import pytest

from sonora.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    same = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else x
    return sorted((tuple(same(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    import duckdb

    df = QUERIES[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())
