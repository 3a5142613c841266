"""Parsing, patterns, the token index and odd URLs."""

import re

from corpus_spark.llm.url_filter import HOST_RULES, PATTERN_RULES, filter_urls, parse_url, pattern_regex, pattern_tokens

URLS = [
    "https://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=1", "https://example.org/en/2", "http://x.com/fr/", "http://x.com/fr",
    "http://x.com/de/a#b", "http://notexample.net/es/", "https://blog.example.net/en/7", "https://example.com/es/3.html", "nothing",
    "", None, "://", "https://", "https://org", "https://org/", "https://a.example.com/x#top", "https://m.example.net/fr/1", "https://x.net/?UTM_source=q",
    "https://x.net/p?page=2&ref=x", "https://x.net/page=2", "http://user@x.com/de/1", "https://x.com?/fr/",
]


def plain(url):
    host, path = parse_url(url)
    fit = [(len(h + p), h + p, v) for v, h, p in HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return max(fit)[1:]
    hits = {v for v, p in PATTERN_RULES if re.search(pattern_regex(p), (url or "").lower())}
    return None, "allow" if "allow" in hits or not hits else "block"


def test_index_changes_nothing(spark):
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = {r.page_id: (r.rule, r.verdict, r.host, r.path) for r in filter_urls(table, HOST_RULES, PATTERN_RULES).collect()}
    assert got == {i: (*plain(u), *parse_url(u)) for i, u in enumerate(URLS * 2)}
    assert filter_urls(table.limit(0), HOST_RULES, PATTERN_RULES).count() == 0
    assert filter_urls(table, []).where("verdict <> 'allow' or rule is not null").count() == 0


def test_parse():
    assert parse_url("HTTP://A.b.C/P/q?x#y") == ("a.b.c", "/P/q")
    assert parse_url("http://a?x/y") == ("a", "")
    assert parse_url("x://y://z/w") == ("y:", "//z/w")
    assert parse_url(None) == parse_url("a/b") == ("", "")


def test_tokens_are_in_every_match():
    assert pattern_tokens("^utm_source=*") == {"utm_source"}
    assert pattern_tokens("||blog.*^en^") == {"blog", "en"}
    assert pattern_tokens("foo*") == set()
    for _, pattern in PATTERN_RULES:
        for url in filter(None, URLS):
            if re.search(pattern_regex(pattern), url.lower()):
                assert pattern_tokens(pattern) <= set(re.findall("[a-z0-9_]+", url.lower()))
