import random
import re

from tidewatch.llm import url_filter as uf
from tidewatch.llm.queries import URL_RULES, op8_url_filters

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_matches_brute_force_with_nested_rules(spark):
    random.seed(6)
    hosts = ["com", "a.com", "b.a.com", "net", "community.org", "x.b.a.com", "", "A.Com"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/70", "/e", "/zz"]
    rules = sorted({(h, p): (h, p, random.choice(["allow", "block"])) for h in hosts[:6] for p in random.sample(paths, 5)}.values())
    urls = [f"{s}{h}{p}{t}" for s in ("http://", "https://", "") for h in hosts for p in paths for t in ("", "?q=/en/", "#f")] + [None, "", "x://", "no scheme", "http://a.com/a://b"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, None), (None, "http://a.com/en/7")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "url AS host", "url AS rule", "1 AS copies")
    got = sorted(((r.page, r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(pages, uf.rule_table(spark, rules), salts=3).collect()), key=repr)
    assert got == sorted(((i, *brute(u, rules)) for i, u in rows), key=repr)
    more = sorted(((r.page, r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(pages, uf.rule_table(spark, rules), salts=1, per_sweep=5).collect()), key=repr)
    assert more == got  # many sweeps of a host, as many as its pages ask for


def test_of_two_rules_as_long_the_one_for_the_longer_host_wins(spark):
    rules = uf.rule_table(spark, [("a.com", "/xx", "block"), ("b.a.com", "/", "allow"), ("a.com", "/y", "allow"), ("a.com", "/y", "block")])
    urls = ["http://b.a.com/xx", "http://b.a.com/q", "http://c.a.com/xx", "http://a.com/y" + "z" * 30_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page: (r.rule, r.verdict) for r in uf.judge_urls(pages, rules).collect()}
    assert got == {0: ("b.a.com/", "allow"), 1: ("b.a.com/", "allow"), 2: ("a.com/xx", "block"), 3: ("a.com/y", "block")}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = uf.rule_table(spark, URL_RULES)
    assert uf.judge_urls(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in uf.judge_urls(pages, rules.limit(0)).collect()] == ["allow"]


def test_query(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op8_url_filters(spark, sf_dir).collect()
    assert len(rows) == len(urls)
    assert all((r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], URL_RULES) for r in rows)
