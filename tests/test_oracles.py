"""Every registered query with SQL gives the SQL's rows (small tables; the driver compares larger ones)."""

import os
import re

import duckdb
import pytest
from strataflow.plans import catalogue
from strataflow.plans.fixtures import TABLES

DATA = "/root/testdata/sf0.001"


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(v, 6) if isinstance(v, float) else str(v) if v is not None else None
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    sql, con = catalogue.oracle_sql()[name], duckdb.connect()
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql) and os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    found = catalogue.queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(names)
    got = comparable([tuple(r) for r in found.collect()], found.columns)
    assert got == comparable(want.fetchall(), names)
