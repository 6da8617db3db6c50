import random

import pytest

from siftloom.llm.url_filters import UrlRule, filter_urls, join_rules, rarest, split_url

RULES = [
    UrlRule("com", "/", "allow"), UrlRule("example.com", "/en/", "block"), UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"), UrlRule("net", "/fr", "block"), UrlRule("a+b.org", "", "block"), UrlRule("example.com", "/xx/", "allow"), UrlRule("example.com", "/xx/", "block"),
]


def brute(url):
    host, path = split_url(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.text), r.verdict != "block", r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_split():
    assert split_url(None) == split_url("") == split_url("a.com/x") == ("", "")
    assert split_url("http://A.B.Com?x") == ("a.b.com", "") and split_url("://h/p?q#r") == ("h", "/p")
    assert split_url("http://x.com#a/b") == ("x.com", "") and split_url("x://É.com/É") == ("É.com", "/É")


@pytest.mark.parametrize("way", [filter_urls, join_rules])
def test_both_ways_equal_brute_force(spark, way):
    rng = random.Random(1)
    hosts = ["example.com", "WWW.example.com", "m.www.example.com", "xexample.com", "a.net", "net", "a+b.org", "aab.org", "com", "example.com:80", ""]
    paths = ["", "/", "/en/", "/en", "/en/a?b=/es/", "/es/x", "/fr", "/french", "/fr/#x", "/xx/1", "//en/", "/en\n/z"]
    urls = [None, "", "nothing", "http:/x", "a://b://c/d"] + [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths]
    df = spark.createDataFrame([(i % 90, u, "mine", "kept") for i, u in enumerate(urls)], "page_id long, url string, host string, token string")
    got = sorted((r.page_id, r.url or "~", r.host, r.path, r.rule or "~", r.verdict, r.token) for r in way(df, RULES).collect())
    assert got == sorted((i % 90, u or "~", *(x or "~" if k == 2 else x for k, x in enumerate(brute(u))), "kept") for i, u in enumerate(urls))
    assert way(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in filter_urls(df, []).collect()} == {"allow"}


def test_rules_are_filed_under_their_rarest_token():
    filed = {r.text: t for t, r in rarest(RULES)}
    assert filed["www.example.com/en/"] == "h:www" and filed["net/es/"] == "p:es" and filed["net/fr"] == "h:net"


def test_ties_are_decided_alike_at_every_number_of_rules(spark, monkeypatch):
    rules = [UrlRule("b.a.com", "/", "block"), UrlRule("a.com", "/x/", "block"), UrlRule("c.com", "/ab", "allow"), UrlRule("com", "/abcd", "allow"), UrlRule("com", "/abce", "block")]
    long = "/x/" + "y" * 300_000
    df = spark.createDataFrame([(i, u) for i, u in enumerate(["http://b.a.com/x/1", "http://c.com/abcd", "http://c.com/abce", f"http://b.a.com{long}"])], "page_id long, url string")
    few = {r.page_id: (r.rule, r.verdict) for r in filter_urls(df, rules).collect()}
    assert few == {0: ("a.com/x/", "block"), 1: ("c.com/ab", "allow"), 2: ("com/abce", "block"), 3: ("a.com/x/", "block")}
    monkeypatch.setattr("siftloom.llm.url_filters.MOST_SENT_RULES", 2)
    assert {r.page_id: (r.rule, r.verdict) for r in filter_urls(df, rules).collect()} == few
