"""op3's rule list is the contract's, word for word."""

from strataflow.llm import url_filter
from strataflow.llm.registry import URL_RULES

CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_rules_are_those_of_the_contract():
    assert {h + p: a for h, p, a in URL_RULES} == CONTRACT


def test_an_allowed_domain_with_a_blocked_path_below(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    urls = ["http://x.net/de/1", "http://example.net/de/7", "http://example.net/de/8/9", "http://a.org/es/", "http://a.example.com/en/7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {0: ("net/de/", "allow"), 1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("org/es/", "block"), 4: ("example.com/en/7", "allow")}
