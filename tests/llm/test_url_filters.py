import re

import pytest

from tablewright.llm.url_filters import CONTRACT_RULES, RuleIndex, UrlRule, filter_urls, host_path_rule, host_word_rule, parts

URLS = [
    "https://www.example.com/en/x", "http://shop.example.com/en/", "http://example.com/EN/", "http://EXAMPLE.com/en/a?b#c", "https://x.net/es/",
    "https://x.net/es", "http://com/", "http://com", "http://xcom/", "http://notexample.com/en/", "ftp://a.b.net/fr/q/../?x=/en/", "no scheme",
    None, "", "://", "http://", "http://a.net?/es/", "http://a.net#/es/", "HTTP://WWW.EXAMPLE.COM/en/1", "http://a.com:80/en/", "x://y://z.net/es/",
    "http://casino-win.example.org/a", "http://a.casino.org", "http://casinos.org/", "http://ok.org/casino", "http://É.com/é", "http://a..net/fr/",
]


def plain(url):
    """Host, path and rule by looking at every rule."""
    if "://" not in (url or ""):
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for r in CONTRACT_RULES:
        h, _, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.name) > len(best.name)):
            best = r
    return host, path, best


def test_equals_all_rules(spark):
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(URLS)] + [(None, URLS[0], 1, "x")], "page_id long, url string, _id int, _url string")
    got = {r.page_id: r for r in filter_urls(pages).collect()}
    for i, u in [*enumerate(URLS), (None, URLS[0])]:
        host, path, rule = plain(u)
        bad = bool(re.search(r"(?:^|[.-])casino(?:[.-]|$)", host))
        assert (got[i].host, got[i].path) == (host, path) == parts(u), u
        assert got[i].hit == (rule.name if rule else "host word casino" if bad else None), u
        assert got[i].verdict == (rule.verdict if rule else "block" if bad else "allow"), u
    assert filter_urls(pages.limit(0)).collect() == []


@pytest.mark.parametrize("rule", ["example.com/en", "example.com/en/", "a-b.org/x1/y", "org/", "example.com/En/Q"])
def test_the_index_misses_no_rule(rule):
    r = host_path_rule(rule, "block")
    for counts in ({}, {t: 100 - i for i, t in enumerate(r.tokens)}, {t: i for i, t in enumerate(r.tokens)}):
        index = RuleIndex((r,), counts)
        for host in ("example.com", "w.example.com", "a-b.org", "z.a-b.org"):
            for path in ("", "/", "/en", "/en/", "/english/", "/En/Q", "/x1/y", "/x1/yes"):
                assert (index.best(host, path) is r) == bool(re.search(r.pattern, host + path))


def test_rare_tokens_and_rules_without_any():
    rules = (host_word_rule("spam"), UrlRule("digits", "block", r"\d{9}"), UrlRule("both", "block", r"x/common/rare", ("common", "rare")))
    index = RuleIndex(rules, {"common": 1000, "rare": 2})
    assert index.by_token == {"spam": [0], "rare": [2]} and index.always == [1]
    assert index.best("a.org", "/123456789").name == "digits" and index.best("x", "/common/rare").name == "both"
    assert index.best("nospam.org", "/") is None
