"""R11 gives every pair of a type and an interface that it implements, in the query and in its SQL."""

import random

import duckdb
from strataflow.operators import resolve
from strataflow.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_query_and_sql_hold_every_pair(spark):
    have, need = catalogue.DIV_HAVE, catalogue.DIV_NEED
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(f"WITH h AS ({have}), d AS ({need}), n AS (SELECT package, interface_id, count(DISTINCT name) AS need FROM d GROUP BY 1, 2) SELECT h.type_id, d.interface_id FROM h JOIN d ON h.package = d.package AND h.name = d.name JOIN n ON n.package = d.package AND n.interface_id = d.interface_id GROUP BY h.package, h.type_id, d.interface_id, n.need HAVING count(*) = n.need").fetchall()
    every = lambda rows: sorted((a, b) for what, a, b in rows if what == "pair")
    assert want and every(con.execute(catalogue.oracle_sql()["R11_implements_division"]).fetchall()) == sorted(want)
    assert every(tuple(r) for r in catalogue.queries()["R11_implements_division"](spark, DATA).select("what", "a", "b").collect()) == sorted(want)


def test_pairs_of_large_classes_are_made_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 8)
    r = random.Random(11)
    have = [(p, f"{p}t{i}", n) for p in ("x", "y") for i in range(90) for n in ("abc" if i < 70 else r.sample("abcdef", 2))]
    have += [("x", "odd", None), (None, "nowhere", "a")]
    need = [(p, f"{p}i{i}", n) for p in ("x", "z", "y") for i in range(60) for n in ("ab" if i < 40 else r.sample("abcdefg", 2))]
    need += [("x", "never", None), (None, "i", "a"), ("y", "half", "a"), ("y", "half", None)]
    methods, required = spark.createDataFrame(have, "package string, type_id string, name string"), spark.createDataFrame(need, "package string, interface_id string, name string")
    con = duckdb.connect()
    con.execute("CREATE TABLE h (package VARCHAR, type_id VARCHAR, name VARCHAR)")
    con.execute("CREATE TABLE d (package VARCHAR, interface_id VARCHAR, name VARCHAR)")
    con.executemany("INSERT INTO h VALUES (?, ?, ?)", have)
    con.executemany("INSERT INTO d VALUES (?, ?, ?)", need)
    want = con.execute("WITH n AS (SELECT package, interface_id, count(DISTINCT name) AS need FROM d GROUP BY 1, 2) SELECT h.type_id, d.interface_id FROM h JOIN d ON h.package = d.package AND h.name = d.name JOIN n ON n.package = d.package AND n.interface_id = d.interface_id GROUP BY h.package, h.type_id, d.interface_id, n.need HAVING count(*) = n.need").fetchall()
    pairs, types, interfaces = resolve.implement_classes(methods, required)
    found = resolve.implement_pairs(pairs, types, interfaces)
    per = [n for (n,) in found.rdd.mapPartitions(lambda rows: [(sum(1 for _ in rows),)]).collect()]
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)
    assert len(per) == 4 and max(per) < len(want) / 2
