import re

from kassa.llm import url_filters

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/es/x", "allow"), ("b.net", "", "block"), ("b.net", "", "allow")]
URLS = [None, "", "no scheme", "http://", "http://com/", "HTTP://WWW.EXAMPLE.com/en/a?x#y", "http://example.com/en/",
        "https://aexample.com/en/", "http://a.www.example.com/en/?q", "http://example.com", "http://x.net/es/xy",
        "http://x.net/es/y", "http://net/es/x#a", "http://b.net?x", "http://c.b.net/es/x", "http://e.x/a://b.net/",
        "://net/es/", "http://example.com:80/en/", "http://.com/", "http://com./", "x://É.NET/es/é"] * 2


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_equals_brute_force(spark):
    rows = [(i if i % 7 else None, u, "extra") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(tuple, url_filters.judge_urls(pages, rules).collect()), key=repr)
    assert got == sorted(((i, *brute(u)) for i, u, _ in rows), key=repr)


def test_hot_host_spreads_and_empty_tables(spark):
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('http://a.net/es/', id) AS url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filters.judge_urls(pages, rules).groupBy("verdict").count().collect()[0]["count"] == 4000
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert url_filters.judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == 4000
