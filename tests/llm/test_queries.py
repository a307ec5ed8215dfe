"""The queries that SQL can express, against DuckDB on the smallest tables."""

import os
from collections import Counter

import pytest

from keepsake.llm import queries

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_embedding_dedup", "op13_importance_resampling"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = Counter(found.fetchall())
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names) and want
    assert Counter(map(tuple, got.select(*names).collect())) == want
