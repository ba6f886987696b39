"""Token shards, URL filters, archives, chats."""

import random

import numpy as np
import pytest
from strataflow.llm import chat, token_shards, url_filter, warc
from strataflow.llm.registry import URL_RULES


@pytest.mark.parametrize("size", [1, 2, 3, 100, 1023, 4097])
def test_feistel_is_a_permutation(size):
    f = token_shards.Feistel(size, 7, 6)
    slots = f.slots(np.arange(size))
    assert sorted(slots) == list(range(size)) and (f.numbers(slots) == np.arange(size)).all()


def test_shards_hold_every_token_in_slot_order(spark, docs, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(80, None), (81, ""), (81, "")]
    p = token_shards.Params(length=16, shard_slots=50)
    root = f"file://{tmp_path}/s"
    out = token_shards.write(docs(rows, extra=("slot", "shard")).repartition(3), root, p).collect()
    assert sorted(r["slot"] for r in out) == list(range(len(out)))
    tok = token_shards.Tokenizer(token_shards.load_ranks(p.ranks))
    whole = token_shards.read_slots(root, 0, len(out))
    texts = dict(rows)
    for r in out:
        want = np.r_[np.frombuffer(tok(texts[r["doc_id"]]), np.uint16), p.end][r["chunk"] * 16 : r["chunk"] * 16 + 16]
        assert (whole[r["slot"]][: len(want)] == want).all() and (whole[r["slot"]][len(want) :] == p.end).all() and r["n_tokens"] == len(want)
    assert (token_shards.read_slots(root, 37, 31) == whole[37:68]).all() and len(token_shards.read_slots(root, len(out) - 3, 99)) == 3
    assert {r["slot"]: r["tokens"] for r in token_shards.scan(spark, root).collect()}[5] == whole[5].tolist()
    assert token_shards.write(docs([]), f"file://{tmp_path}/e", p).count() == 0


def test_slots_are_the_permutation_of_dense_numbers(spark, docs, tmp_path):
    rows = [(i, "word " * (7 * i)) for i in range(40)] + [(40, "long " * 30_000)]
    p = token_shards.Params(length=16, shard_slots=8, max_shards=100)
    out = token_shards.write(docs(rows).coalesce(1), f"file://{tmp_path}/p", p).collect()
    order, m = token_shards.Feistel(len(out), p.key, p.rounds), token_shards.read_manifest(f"file://{tmp_path}/p")
    numbered = sorted(out, key=lambda r: (r["doc_id"], r["chunk"]))
    assert [r["slot"] for r in numbered] == order.slots(np.arange(len(out))).tolist()
    assert m["shard_slots"] >= len(out) / 100 and {r["shard"] for r in out} == set(range(m["shards"])) and m["shards"] <= 100
    assert all(r["shard"] == r["slot"] // m["shard_slots"] and r["byte_offset"] == r["slot"] % m["shard_slots"] * 32 for r in out)


def test_vocabularies_never_share_a_tokenizer():
    ranks = token_shards.load_ranks(token_shards.RANKS)
    other = dict(ranks)
    a, b = list(other)[40_000:40_002]
    other[a], other[b] = other[b], other[a]
    one, two = token_shards.tokenizer(ranks), token_shards.tokenizer(other)
    assert one is not two and token_shards.tokenizer(ranks) is not two and token_shards.vocabulary_key(ranks) != token_shards.vocabulary_key(other)


def test_url_rules(spark):
    urls = ["http://a.Example.COM:80/en/7?x", "http://example.com/en/77", "http://example.com/en/8#f", "https://com/en/", "http://notexample.com/en/7", "http://x.net/de/1", "http://example.net/de/8/9", "http://x.org/en/", None, "no scheme", "http://", "http://x.com?/en/", "http://example.com/EN/7"]
    want = ["allow", "allow", "block", "block", "block", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(0, urls[0], "h", "r")], "page_id long, url string, host string, rule string")
    out = url_filter.judge(pages, spark.createDataFrame(URL_RULES, "host string, path string, action string")).collect()
    assert len(out) == len(urls) + 1
    got = {r["page_id"]: r for r in out}
    assert [got[i]["verdict"] for i in range(len(urls))] == want
    assert got[0]["host"] == "a.example.com:80" and got[1]["rule"] == "example.com/en/7" and got[8]["host"] == "" and got[11]["path"] == ""
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(URL_RULES, "host string, path string, action string")).count() == 0


def test_url_filter_passes_clashing_columns_and_long_urls(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    long = "http://a.com/en/" + "x/" * 100_000
    pages = spark.createDataFrame([(1, long, "p", "q", "r"), (2, None, "p", "q", "r"), (2, None, "p", "q", "r"), (3, "http://b.org/es/", "p", "q", "r")], "page_id long, url string, best string, row string, key string")
    out = url_filter.judge(pages, rules)
    assert out.columns == ["page_id", "url", "best", "row", "key", "host", "path", "rule", "verdict"]
    got = sorted(((r["page_id"], r["verdict"], r["best"], r["rule"]) for r in out.collect()), key=str)
    assert got == [(1, "block", "p", "com/en/"), (2, "allow", "p", None), (2, "allow", "p", None), (3, "block", "p", "org/es/")]
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_a_cut_archive_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", f"body {i}") for i in range(9)], "page_id long, url string, html string")
    parts = warc.write(pages, f"file://{tmp_path}/w", warc.Params(parts=1))
    path = parts.first()["archive"].split(":", 1)[1]
    path = path.removeprefix("//")
    with open(path, "rb") as f:
        data = f.read()
    with open(path, "wb") as f:
        f.write(data[:-6])
    for by_index in (False, True):
        with pytest.raises(Exception, match="member|records|incomplete|truncated"):
            warc.scan(spark, parts, by_index=by_index).collect()


def test_warc_round_trip_and_lookup(spark, tmp_path):
    body = "<p>é</p>\r\n\r\nWARC/1.1" * 50
    rows = [(1, "http://b.x.com/1", body), (2, "http://a.x.com/2", body), (3, "http://a.x.com/2", None), (4, None, ""), (5, "bad url", "y" * 300_000), (6, "http://a.x.com/2?q=\t#f", "z"), (6, "http://c.org/", "z"), (None, "http://c.org/n", "w")]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, payload string")
    parts = warc.write(pages, f"file://{tmp_path}/w", warc.Params(block_lines=2, parts=3))
    got = warc.scan(spark, parts, payloads=True).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["url"]): r for r in got}
    assert by[1, "http://b.x.com/1"]["payload"].decode() == body and by[1, "http://b.x.com/1"]["record_type"] == "response"
    assert (by[2, "http://a.x.com/2"]["record_type"], by[2, "http://a.x.com/2"]["refers_to"], by[2, "http://a.x.com/2"]["payload_bytes"]) == ("revisit", 1, len(body.encode()))
    assert by[4, ""]["refers_to"] == 3 and by[3, "http://a.x.com/2"]["payload_digest"] == warc.base32_sha1(b"")
    asked = spark.createDataFrame([("http://a.x.com/2",), ("http://c.org/",), ("http://none/",), ("bad url",)], "u string")
    found = sorted((r["asked"], r["page_id"], r["record_type"]) for r in warc.lookup(asked, parts).collect())
    assert found == [("bad url", 5, "response"), ("http://a.x.com/2", 2, "revisit"), ("http://a.x.com/2", 3, "response"), ("http://c.org/", 6, "response")]
    empty = warc.write(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.scan(spark, empty).count() == 0


def test_snapshots_collapse_to_maximal_conversations(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, "user", None), (5, 0, None, "z"), (6, 7, "user", "hi"), (6, 2500, "assistant", "yo"), (6, 2501, "user", "bye"), (None, 0, "user", "x"), (8, 0, "assistant", "hi")]
    df = spark.createDataFrame([(*t, "q") for t in turns], "conv_id long, turn long, role string, text string, position string")
    out = chat.render(df).collect()
    assert {r["conv_id"] for r in out} == {4, 5, 6, 8}
    six = sorted((r["position"], r["rendered"], r["is_target"]) for r in out if r["conv_id"] == 6)
    assert six == [(0, "<|user|>\nhi<|end|>\n", False), (1, "<|assistant|>\nyo<|end|>\n", True), (2, "<|user|>\nbye<|end|>\n", False)]
    assert chat.render(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(c, t, "user", f"t{t}") for c in (9, 7) for t in range(1500)], "conv_id long, turn long, role string, text string")
    kept = chat.maximal(copies)
    assert kept.select("conv_id").distinct().collect()[0][0] == 7 and kept.count() == 1500
