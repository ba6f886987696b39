"""Queries run over whole tables, and so does their SQL."""

import os
import re

import duckdb
import pytest
from strataflow.plans import catalogue
from strataflow.plans.fixtures import TABLES

DATA = "/root/testdata/sf0.01"

#: Queries that read every row of large tables; their SQL does too.
WHOLE = [
    "W22_violations", "W22_first_violation", "R5_import_edges", "R6_symbol_targets", "R9_unique_calls", "R10_method_calls", "R11_implements_division", "G1_traverse_limited", "G10_find_path", "G21_edge_dedupe", "L5_rank_retrievals",
    "L7_match_groups", "L8_store_tokens", "L9_question_tokens", "L10_catalog_tokens", "L17_seed_components", "L18_rrf", "L19_diversify", "L20_prefer_exact_label", "N1_affected_sources", "G12_dependents",
]


@pytest.mark.parametrize("name", WHOLE)
def test_query_covers_the_whole_tables(spark, name):
    sql = catalogue.oracle_sql()[name]
    con = duckdb.connect()
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql) and os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = catalogue.queries()[name](spark, DATA)
    order = lambda rows: sorted(tuple(rows), key=repr)
    want = con.execute(sql)
    assert [c[0] for c in want.description] == found.columns
    assert order(tuple(r) for r in found.collect()) == order(want.fetchall())
