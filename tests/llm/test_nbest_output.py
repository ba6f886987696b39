"""Encoding delivers all N segmentations, not the best one only."""

import numpy as np
import xxhash
from strataflow.llm import pieces as P
from strataflow.llm import registry


def test_encode_returns_every_segmentation(spark, docs):
    v = P.load()
    texts = ["the thing", "", None, "  two  spaces ", "naïve 日本 🙂\n\ttab", "a▁b"]
    out = P.encode(docs(list(enumerate(texts))), v, n=3).collect()
    enc = P.Encoder(v, 3)
    for r in out:
        text = texts[r["doc_id"]]
        want = [tuple(np.frombuffer(p, np.int32).tolist()) for _, p in enc(text)[0]]
        assert [tuple(x) for x in r["nbest_ids"]] == want and len(set(want)) == len(want) == (3 if text else 1)
        assert tuple(r["ids"]) == want[0] and r["n_tokens"] == len(want[0])
        digests = [xxhash.xxh3_64_intdigest(np.array(x, np.int32).tobytes()) for x in want]
        assert [x % 2**64 for x in r["nbest_xxh64"]] == digests and r["ids_xxh64"] == r["nbest_xxh64"][0]
        assert r["round_trip"] == all(P.decode(v, x) == (text or "") for x in want) == ("▁" not in (text or ""))


def test_op2_returns_the_segmentations(spark, docs, tmp_path):
    """The registered query returns the ids of both segmentations themselves, not their digests only."""
    v = P.load()
    texts = ["the thing", "", None, "  two  spaces ", "naïve 日本 🙂\n\ttab", "x" * 5_000]
    docs(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.queries()["op2_sentencepiece"](spark, str(tmp_path))
    assert {"ids", "nbest_ids"} <= set(out.columns)
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    score = {i: s for i, s in v.scores.values()}
    for r in rows:
        text, every = texts[r["doc_id"]] or "", [list(x) for x in r["nbest_ids"]]
        assert len(every) == len({tuple(x) for x in every}) == len(r["nbest_scores"]) == (2 if text else 1)
        assert list(r["ids"]) == every[0] and r["n_tokens"] == len(every[0]) and r["score"] == r["nbest_scores"][0]
        assert all(P.decode(v, x) == text for x in every) and r["round_trip"]
        assert [xxhash.xxh3_64_intdigest(np.array(x, np.int32).tobytes()) for x in every] == [x % 2**64 for x in r["nbest_xxh64"]]
        if text.isascii():  # each character has a piece: the score is the sum of the pieces' scores
            assert [sum(score[i] for i in x) for x in every] == r["nbest_scores"]
