"""R11's classes and members stand for exactly the pairs of the plain division."""

import duckdb
from strataflow.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_classes_expand_to_every_pair(spark):
    have, need = catalogue.DIV_HAVE, catalogue.DIV_NEED
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(f"WITH h AS ({have}), d AS ({need}), n AS (SELECT package, interface_id, count(DISTINCT name) AS need FROM d GROUP BY 1, 2) SELECT h.type_id, d.interface_id FROM h JOIN d ON h.package = d.package AND h.name = d.name JOIN n ON n.package = d.package AND n.interface_id = d.interface_id GROUP BY h.package, h.type_id, d.interface_id, n.need HAVING count(*) = n.need").fetchall()
    rows = [tuple(r) for r in catalogue.queries()["R11_implements_division"](spark, DATA).select("what", "a", "b").collect()]
    members = {what: {} for what in ("type", "interface")}
    for what, a, b in rows:
        if what in members:
            members[what].setdefault(a, []).append(b)
    got = [(t, i) for what, a, b in rows if what == "implements" for t in members["type"][a] for i in members["interface"][b]]
    assert want and sorted(got) == sorted(want)
