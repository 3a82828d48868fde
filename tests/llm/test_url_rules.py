"""URL verdicts against a plain loop over rules, with odd urls, ties, repeats, hash collisions and clashing columns."""

import random

import pytest

from quillon.llm import url_rules
from quillon.llm.queries import URL_RULES
from quillon.llm.url_rules import judge_urls

ODD = [None, "", "http://", "no scheme", "https://EXAMPLE.com", "http://example.com/en/7x", "http://a.example.com/en/1?x=/en/7", "ftp://badexample.com/en/7",
       "http://x.example.net/de/8#f", "http://example.net/de/9", "http://org/es/", "http://.org/es/1", "x://a://b/en/", "http://com", "http://com/en/", "http://É.com/en/ü", "http://example.com?q=/en/7", "http://u@example.com:80/en/7"]


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    raw, after = rest[:cut], rest[cut:]
    end = min([after.find(c) for c in "?#" if c in after], default=len(after))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in raw), after[:end]


def plain(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    rows = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), **more).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_odd_urls(spark):
    got = judged(spark, ODD, URL_RULES)
    assert got == {k: plain(u, URL_RULES) for k, u in enumerate(ODD)}


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules).collect()}
    assert got == {r.page_id: plain(r.url, URL_RULES) for r in pages.collect()}
    assert len({v[2] for v in got.values()}) > 3


@pytest.mark.parametrize("limit, shapes", [(200_000, 40), (200_000, 1), (3, 40)])
def test_many_rules_with_ties(spark, monkeypatch, limit, shapes):
    """A join for each shape, or expressions exploded, with rules broadcast or shuffled; of equal lengths the longer host wins, of equal rules block."""
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", limit)
    monkeypatch.setattr(url_rules.judge_urls, "__defaults__", ("allow", shapes))
    r = random.Random(2)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net"]
    rules = [(r.choice(hosts), "/" + "".join(r.choices("ab/", k=r.randrange(4))), r.choice(["allow", "block"])) for _ in range(60)]
    urls = [f"http://{r.choice(['', 'w.', 'q.w.'])}{r.choice(hosts)}/{''.join(r.choices('ab/', k=r.randrange(6)))}" for _ in range(300)]
    worst = [(h, p, "block" if (h, p, "block") in rules else v) for h, p, v in rules]
    assert judged(spark, urls, rules) == {k: plain(u, worst) for k, u in enumerate(urls)}


def test_prefix_collisions_are_refused(spark, monkeypatch):
    """With one hex digit of prefix nearly all expressions meet some rule: the digests decide."""
    monkeypatch.setattr(url_rules, "PREFIX", 1)
    urls = ODD + [f"http://site{k}.com/en/{k}" for k in range(100)]
    assert judged(spark, urls, URL_RULES) == {k: plain(u, URL_RULES) for k, u in enumerate(urls)}


def test_void_rules_and_none(spark):
    void = [(None, "/", "block"), ("", "/", "block"), ("com", None, "block"), ("com", "/", "maybe")]
    assert set(judged(spark, ODD, void, default="block").values()) == {(*parts(u), None, "block") for u in ODD}


def test_clashing_columns_repeats_and_no_rows(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    names = ["rank", "prefix", "rule_prefix", "rule_digest", "digest", "row", "own", "labels", "path_len", "_row", "_digest"]
    schema = "url string, host int, verdict int, rule int, path int, " + ", ".join(f"{n} int" for n in names)
    pages = spark.createDataFrame([("http://example.com/en/7", 1, 2, 3, 4, *range(len(names)))] * 3, schema)
    rows = judge_urls(pages, rules).collect()
    assert len(rows) == 3
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == ("example.com", "/en/7", "example.com/en/7", "allow")
        assert [r[n] for n in names] == list(range(len(names)))
    assert judge_urls(pages.limit(0), rules).count() == 0
    mapped = pages.selectExpr("url", "map('a', 1) AS m")
    assert [r.m for r in judge_urls(mapped, rules).collect()] == [{"a": 1}] * 3


def test_pages_stay_in_their_tasks(spark):
    """No exchange has a column of pages: rules are few, so pages are not shuffled; with many, hosts, paths and ranks are."""
    pages = spark.createDataFrame([(1, "http://a.com/en/x", "<html>")], "page_id long, url string, html string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    lines = judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert all("Broadcast" in x or "hashpartitioning(labels" in x or "hashpartitioning(host" in x for x in lines if "Exchange" in x)
    assert not any("own" in x for x in lines if "Exchange" in x)
