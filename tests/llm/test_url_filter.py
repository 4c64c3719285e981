import random
import re

from candlespan.llm.url_filter import RULES, judge_urls, rules_table


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for verdict, h, p in rules:
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (), (len(h) + len(p), len(h), verdict, h + p))
    return host, path, best and best[3], best[2] if best else default


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(pages, rules_table(spark, rules)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_contract_rules(spark):
    check(spark, [
        None, "", "no scheme", "http://", "http://ORG/", "http://org", "https://a.Example.org/es/1", "http://example.org/en/12?x#y",
        "http://notexample.org/es/", "http://x.com/de/", "http://x.com/de", "http://x.com/fr/://a.org/", "://é.org/\nq", "http://a.org?/es/",
        "http://.org/", "http://a..org/x", "http://a.org./x", "http://u@b.com:80/de/", "x" * 5000 + "://c.com/fr/" + "y" * 20000,
    ] + ["http://hot.com/de/1"] * 50, RULES)


def test_random_rules(spark):
    rng = random.Random(3)
    hosts = ["a", "b.a", "c.b.a", "x.a", "xa"]
    paths = ["", "/", "/p", "/p/", "/p/q", "/pq"]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h in [*hosts, ""] for p in paths if rng.random() < 0.4}.values())
    check(spark, [f"http://{rng.choice(['', 'w.', 'b.'])}{h}{p}{t}" for h in hosts for p in paths for t in ("", "z", "?p")], rules)


def test_tie_and_null_id(spark):
    pages = spark.createDataFrame([(None, "http://a/b"), (None, "http://a/b")], "page_id long, url string")
    rules = rules_table(spark, [("allow", "a", "/b"), ("block", "a", "/b")])
    assert [tuple(r) for r in judge_urls(pages, rules).collect()] == [(None, "a", "/b", "a/b", "block")] * 2
    assert judge_urls(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_hosts_of_very_many_labels(spark):
    long = "a." * 20_000
    check(spark, [f"http://{long}org/x", f"http://{long}example.org/es/1", f"http://{long}/x", "http://" + "." * 20_000 + "org/"], RULES)
