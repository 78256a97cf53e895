"""URL rules against trying every rule on every URL."""

import random

import numpy as np
import pytest

from textrec.llm import urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/", "block"), ("a.com", "", "allow")]


def slow(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, otherwise))
    return host, path, best[3], best[4]


URLS = [None, "", "no scheme", "http://", "http://Example.ORG/en/12?x", "https://b.example.org/es/#t", "x://a.com", "x://b.a.com/y?z", "x://notexample.org/es/", "x://example.org?a/es/", "x://É.org/", "x://c.com:80/", "x://u@d.com/a://b", "x://" + "s." * 5000 + "org/" + "p" * 100_000, "line\nx://e.org/\nq"]


@pytest.mark.parametrize("array_rules", [1_000_000, 2])
def test_as_every_rule_on_every_url(spark, array_rules):
    rng = random.Random(1)
    own = URLS + ["http://" + ".".join(rng.choices(["a", "example", "www"], k=rng.randint(0, 3)) + [rng.choice(["org", "com", "net"])]) + rng.choice(["", "/", "/es/", "/es", "/en/1", "/en/1234", "/en/2", "/ES/"]) + rng.choice(["", "?q=/es/", "#x"]) for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(own)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES + RULES[:1], "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(pages, rules, array_rules=array_rules).collect()}
    assert got == {i: slow(u, RULES) for i, u in enumerate(own)}


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(urls, "_digest", lambda text: 7)
    arrays = urls.digest_arrays(RULES)
    assert len(np.unique(arrays["keys"])) == 1
    found = urls.best_rules(arrays, ["example.org", "x.com", "net"], ["/en/1", "/", "/"])
    assert {i: f[3] for i, f in found.items()} == {0: "example.org/en/1", 1: "com/"}


def test_no_rules_no_pages_null_rules(spark):
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(None, "x://a.b/c"), (1, "x://a.b/c")], "page_id long, url string")
    assert {tuple(r) for r in urls.judge_urls(pages, empty, otherwise="block").collect()} == {(None, "a.b", "/c", None, "block"), (1, "a.b", "/c", None, "block")}
    odd = spark.createDataFrame([(None, None, "block")], empty.schema)
    assert urls.judge_urls(pages, odd).where("rule IS NOT NULL").count() == 0
    assert urls.judge_urls(pages.limit(0), odd).count() == 0
