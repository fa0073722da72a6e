import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import url_rules as U
from quarry.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    return host, path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]


def verdict(url, rules):
    host, path = parts(url)
    fits = [(len(h + (p or "")), len(h), h + (p or ""), v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://net/", "https://a.b.NET/x?y", "http://xnet/", "http://example.net/en/1", "http://m.example.net/en", "x://example.com/de/#",
    "http://a.example.com/de/x?z", "http://org/fr/", "ftp://deep.sub.org/fr/a://b", "http://u@example.org:80/fr/", "http://É.net/é", "://net/", "http://.net/", "http://net./", "http://a..net/\n/x", "http://example.com?/de/",
]


def check(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("clash"), "key": F.lit(1)})
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judged(pages, table).collect()}
    assert found == {i: verdict(u, rules) for i, u in enumerate(urls)}


def test_contract_rules(spark):
    check(spark, URLS, URL_RULES)


@pytest.mark.parametrize("group", [20_000, 15])
def test_nested_rules_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(U, "GROUP_ROWS", group)
    rng = random.Random(group)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "com"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "a", "b", "/a/"]) for _ in range(rng.randint(0, 5)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(60))}.values())
    rules += [("com", None, "block"), (None, "/x", "block"), ("", "/", "block")]
    urls = [f"http://{host()}/{path()}" for _ in range(150)] + ["http://a.com/a/b"] * 60
    check(spark, urls + URLS, rules)


def test_no_rules_no_pages_and_conflicts(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r.verdict for r in U.judged(pages, none, default="block").collect()] == ["block"] * 3
    assert U.judged(pages.limit(0), none).count() == 0
    both = spark.createDataFrame([("net", "/", "allow"), ("net", "/", "block")], none.schema)
    assert sorted((r.rule or "", r.verdict) for r in U.judged(pages, both).collect()) == [("", "allow"), ("net/", "block"), ("net/", "block")]
