"""The registered queries against their SQL on the smallest tables."""

import os
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
from sonora.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    import duckdb

    df = QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(names).collect())) == Counter(want.fetchall())
