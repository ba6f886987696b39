"""The queries that SQL can express give the SQL's rows on small tables."""

import os
import re

import duckdb
import pytest
from strataflow.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    sql, con = registry.oracle_sql()[name], duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        if re.search(rf"\b{t}\b", sql) and os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    found = registry.queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(names)
    clean = lambda v: round(v, 6) if isinstance(v, float) else str(v)
    rows = lambda some: sorted(tuple(map(clean, r)) for r in some)
    assert rows(found.select(*names).collect()) == rows(want.fetchall())
