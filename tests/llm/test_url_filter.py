"""Operator 10 beside plain Python rules."""

from chaintrail.llm import url_filter as U

SCHEMA = "page_id long, url string, host string, rule string"


def judged(spark, urls):
    rules = [U.host_rule(*r) for r in U.HOST_RULES] + [U.pattern_rule(*r) for r in U.PATTERN_RULES]
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], SCHEMA)
    return {r.page_id: r for r in U.judge(frame, rules).collect()}


def test_rules(spark):
    cases = {
        "http://A.Example.NET/en/x": ("example.net/en/", "allow"), "http://example.net/en": ("net/", "block"),
        "http://net/": ("net/", "block"), "http://x.net": (None, "allow"), "http://xnet/": (None, "allow"),
        "http://notexample.net/en/": ("net/", "block"), "http://a.example.com/de/1?net/": ("example.com/de/", "block"),
        "http://example.com/DE/": (None, "allow"), "http://w.org/fr/": ("org/fr/", "allow"), "http://w.org/x/fr/": (None, "allow"),
        "http://ads.site.io/": (None, "block"), "http://tracking.io/": (None, "block"), "http://a.io/banner/1": (None, "block"), "http://a.io/Popunder/x.js": (None, "block"), "http://a.io/popunder/x.jsx": (None, "allow"),
        "http://ad.w.org/fr/": ("org/fr/", "allow"), "a.net/": (None, "allow"), "": (None, "allow"), None: (None, "allow"),
        "http://x.net?/": (None, "allow"), "http://x.net#/": (None, "allow"), "x://y://z.net/": (None, "allow"),
    }
    got = judged(spark, list(cases))
    for i, (url, want) in enumerate(cases.items()):
        assert (got[i].rule, got[i].verdict) == want, url
    assert (got[0].host, got[0].path) == ("a.example.net", "/en/x")
    assert (got[16].host, got[16].path) == ("", "") and (got[18].host, got[18].path) == ("", "")
    assert judged(spark, []) == {}


def test_tokens_of_patterns():
    assert U.pattern_rule("block", "||ads.").tokens == ("ads",)
    assert U.pattern_rule("block", "/pop*under/x/*.js|").tokens == ("x", "js")
    assert U.host_rule("block", "a.b/c/de").tokens == ("a", "b", "c")
