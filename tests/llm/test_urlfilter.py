import random
import re

import matchloom.llm.urlfilter as urlfilter
from matchloom.llm.urlfilter import blocked_bloom, judge_urls, match_listed, passing

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, (max(fit)[2], max(fit)[3]) if fit else (None, None)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", 1, "y") for i, u in enumerate(urls)], "page_id long, url string, html string, h int, key string")


def test_rules_against_brute_force(spark):
    random.seed(1)
    hosts = ["EXAMPLE.org", "a.b.example.org", "xexample.org", "org", "com", "shop.com", "x.net", "example.org:80", ""]
    urls = [f"http://{random.choice(hosts)}{random.choice(['', '/', '/es/', '/en/12', '/en/2', '/fr/1', '/de/x', '/ES/'])}{random.choice(['', '?q=/es/', '#/de/'])}" for _ in range(200)]
    urls += [None, "", "no scheme/es/", "ftp://a://b/c", "://org/x", "http://ex\nample.org/es/"]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: r for r in judge_urls(pages(spark, urls), rules, spark.createDataFrame([], "url string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, (rule, verdict) = brute(u, RULES)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u


def test_listed_urls_by_canonical_form(spark):
    listed = spark.createDataFrame([("http://www.Bad.net/a//b/?utm_source=1&z=2&a=1#top",), (None,)], "url string")
    urls = ["https://bad.net:443/a/b?a=1&z=2", "http://bad.net/a/b?z=2&a=1&ref=q", "http://bad.net/a/b", "http://bad.net/A/b?a=1&z=2"]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in judge_urls(pages(spark, urls), none, listed).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow"}
    assert judge_urls(pages(spark, urls), none, spark.createDataFrame([], "url string")).where("verdict <> 'allow'").count() == 0
    assert judge_urls(pages(spark, urls).where("false"), none, listed).count() == 0


def test_filter_has_no_false_negatives_and_the_join_no_false_positives(spark):
    listed = spark.range(3000).selectExpr("concat('k', id) AS key", "id AS n")
    probes = spark.range(0, 60000, 3).selectExpr("concat('k', id) AS key", "id AS probe")
    found = match_listed(probes, listed)
    assert sorted(r.probe for r in found.collect()) == list(range(0, 3000, 3)) and all(r.probe == r.n for r in found.collect())
    bloom, blocks = blocked_bloom(listed.select("key"), 3000)
    assert blocks == 141 and bloom.count() <= blocks


def test_the_filter_cuts_nearly_all_other_probes(spark):
    listed = spark.range(3000).selectExpr("concat('k', id) AS key")
    others = spark.range(3000, 43000).selectExpr("concat('k', id) AS key")
    assert passing(others, *blocked_bloom(listed, 3000)).count() <= 0.02 * 40_000
    bloom, blocks = blocked_bloom(listed, 3000, most=50)  # a filter at its bound: about 4 bits a key
    assert blocks == 50 and passing(listed, bloom, blocks).count() == 3000 and passing(others, bloom, blocks).count() <= 0.5 * 40_000


def test_long_lists_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BROADCAST_KEYS", 10)
    listed = spark.range(0, 3000, 3).selectExpr("concat('http://a.net/', id, '?utm_source=z') AS url")
    urls = [f"http://www.a.net/{i % 2000}/" for i in range(2500)] + ["http://a.net/0"] * 1200
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = judge_urls(pages(spark, urls), none, listed).collect()
    assert len(got) == len(urls) and all((r.verdict == "block") == (int(urls[r.page_id].rstrip("/").rsplit("/", 1)[1]) % 3 == 0) for r in got)
