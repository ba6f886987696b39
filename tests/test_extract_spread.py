"""Parsing is dealt to many tasks however few the scan has, and one table is what all tables hold of it."""

import pytest
from strataflow.sources import extract

GO = "package p\n// F does.\nfunc F() { g() }\ntype t struct{}\n"
JS = "import d, { a as b } from './m'\nexport class C extends d { m(x) { this.n(); b(x) } }\nexport { C as K }\n"


def sources(spark, n):
    return spark.createDataFrame([(f"src/f{i}.{e}", lang, text) for i in range(n) for e, lang, text in (("go", "go", GO), ("js", "javascript", JS))], "path string, language string, content string").coalesce(1)


def test_one_scan_task_becomes_many(spark):
    found = extract.extract(sources(spark, 400), "symbols")
    assert found.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert found.count() == 400 * extract.extract(sources(spark, 1), "symbols").count()


@pytest.mark.parametrize("name", sorted(extract.TABLES))
def test_one_table_equals_its_part_of_all(spark, name):
    some = sources(spark, 3)
    one, every = extract.extract(some, name), extract.table(extract.extract_all(some), name)
    assert one.dtypes == every.dtypes
    assert sorted(map(repr, one.collect())) == sorted(map(repr, every.collect())) != []


def test_batches_are_cut(spark, monkeypatch):
    whole = sorted(map(repr, extract.extract(sources(spark, 5)).collect()))
    monkeypatch.setattr(extract, "BATCH", 2)
    assert sorted(map(repr, extract.extract(sources(spark, 5)).collect())) == whole
