import corpus_pipeline
import pytest


def test_pipeline_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    docs, sizes = before, [before.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == before.columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == sizes[-1] and last.filter("not round_trip").count() == 0


@pytest.mark.parametrize("name", ["STAGES", "run", "ORACLE_SQL"])
def test_interface(name):
    assert hasattr(corpus_pipeline, name)


def write(df, path, name):
    df.write.parquet(f"{path}/{name}.parquet")


def tables(spark, path, rows, labels, items, extra=()):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    write(docs.withColumns({c: F.lit("x") for c in extra}), path, "documents")
    write(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), path, "labels")
    write(spark.createDataFrame(items, "item_id long, text string"), path, "benchmark")


WORDS = "the quiet river bends past seven old stone mills and a field of barley where larks rise at dawn".split()
PASSAGE = "which of these planets has the shortest year among all known rocky worlds near us"


def text(k, n=60):
    return " ".join(WORDS[(i * (k + 3) + i // 7 + k) % len(WORDS)] + (str(i % (k + 2)) if i % 5 == 0 else "") for i in range(n))


def test_pipeline_edge_cases(spark, tmp_path):
    """Null ids and texts, repeated rows, copies, near copies, leaks, clashing columns."""
    near = text(5, 80).split()
    rows = [(1, text(1)), (1, text(1)), (2, text(1)), (3, None), (4, ""), (None, text(2)), (None, text(2)), (5, " ".join(near)), (6, " ".join(near[:-1] + ["end"])), (7, "see " + PASSAGE + " again"), (None, "so " + PASSAGE), (8, text(9) * 400)]
    labels = [(100 + i, 1, 0) for i in range(4)]
    tables(spark, tmp_path, rows, labels, [(0, PASSAGE)], extra=("item_id", "component_id", "toxicity", "row", "tokens", "score"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted((r["doc_id"] for r in out), key=str)
    # of copies the largest id stays; a null id is never a near copy or a leak; 3 and 4 are one empty text
    assert ids == sorted([2, 4, None, 5, None, 8], key=str)
    assert all(r["round_trip"] for r in out)


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_pipeline_with_an_empty_table(spark, tmp_path, empty):
    rows = [] if empty == "documents" else [(1, text(1)), (2, text(4))]
    labels = [] if empty == "labels" else [(1, 1, 0), (2, 1, 0)]
    items = [] if empty == "benchmark" else [(0, PASSAGE)]
    tables(spark, tmp_path, rows, labels, items)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [i for i, _ in rows]
