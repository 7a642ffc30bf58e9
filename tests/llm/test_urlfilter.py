from __future__ import annotations

import random

from siltbed.llm import urlfilter as U


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "https://A.Example.NET/en/x?q#f", "http://example.net/en", "http://example.net/en/",
    "http://notexample.net/de/", "ftp://x.example.com/de/a", "http://x.org/fr/", "http://org?x://y/fr/", "http://a.org#/fr/", "http://u:p@x.net:80/", "x://y://net/", "http://é.net/ü",
]


def test_both_ways_equal_brute_force(spark):
    random.seed(1)
    labels = ["net", "example", "com", "a", "b", "org", "x-y"]
    rules = [*U.RULES, ("block", "a.b.net", "/"), ("allow", "b.net", "/p/q"), ("block", "b.net", "/p/q"), ("allow", "x-y.com", "")]
    urls = URLS + [f"http://{'.'.join(random.choices(labels, k=random.randint(1, 5)))}{random.choice(['', '/', '/en/', '/p/q/r', '/de/?x'])}" for _ in range(400)]
    urls += ["http://hot.net/en/"] * 100
    pages = spark.createDataFrame([(k, u, "c") for k, u in enumerate(urls)], "page_id long, url string, host string")
    want = [(k, u, "c", *brute(u, rules)) for k, u in enumerate(urls)]
    table = U.rules_table(spark, tuple(rules))
    for limit in (U.MAX_RULE_BYTES, 1):
        found = U.judge_urls(pages, table, max_rule_bytes=limit)
        assert found.columns == ["page_id", "url", "host", "_host", "path", "rule", "verdict"]
        assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[0]) == want


def test_no_rules_and_no_rows(spark):
    rules = U.rules_table(spark, (("block", "", "/"),))
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in U.judge_urls(pages, rules).collect()] == ["allow"]
    assert U.judge_urls(pages.limit(0), U.rules_table(spark)).collect() == []


def test_columns_of_any_name_pass_both_ways(spark):
    pages = spark.createDataFrame([(1, "http://www.example.net/en/x", 1, 2, 3, "k"), (2, None, 1, 2, 3, "k")], "page_id long, url string, h int, p int, best int, host string")
    rules = U.rules_table(spark)
    for most in (U.MAX_RULE_BYTES, 0):
        got = U.judge_urls(pages, rules, most)
        assert got.columns == [*pages.columns, "_host", "path", "rule", "verdict"]
        assert sorted((r.page_id, r.rule, r.verdict) for r in got.collect()) == [(1, "example.net/en/", "allow"), (2, None, "allow")]
