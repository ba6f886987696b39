"""op4's rows come through the directory and the index blocks."""

import os

import pytest
from strataflow.llm import registry, warc

PAGES = [(i % 90, f"http://h{i % 7}.org/{i}", "same" if i % 3 else f"body {i}") for i in range(100)] + [(None, None, None)]


def test_index_covers_every_record(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    parts = warc.write(pages, f"file://{tmp_path}/w", warc.Params(block_lines=4, parts=3))
    by_index, stream = (sorted(map(repr, warc.scan(spark, parts, True, x).collect())) for x in (True, False))
    assert by_index == stream and len(stream) == len(PAGES)


def test_op4_fails_on_a_wrong_index(spark, tmp_path, monkeypatch):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    write = warc.write

    def spoiled(pages, root):
        parts = write(pages, root)
        d = parts.select("directory").first()[0].removeprefix("file://")
        with open(d if os.path.exists(d) else d.removeprefix("file:")) as f:
            lines = f.read().split("\n")
        with open(d.removeprefix("file:"), "w") as f:
            f.write("\n".join(["wrong\t" + x.split("\t", 1)[1] for x in lines]))
        return parts

    monkeypatch.setattr(warc, "write", spoiled)
    with pytest.raises(Exception, match="does not begin with its key"):
        registry.queries()["op4_warc"](spark, str(tmp_path)).collect()
