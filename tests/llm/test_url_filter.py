"""URL filters against a plain loop over all rules."""

import random

import pytest

from plumbline.llm import url_filter
from plumbline.llm.url_filter import RULES

SCHEMA = "page_id long, url string, host string, rule int, n string"


def plain(url, rules, default="allow"):
    text = url or ""
    at = text.find("://")
    rest = text[at + 3 :] if at >= 0 else ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    for mark in "?#":
        path = path.partition(mark)[0]
    fits = [(len(h) + len(p or ""), len(h), v == "block", h + (p or "")) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "") and (not p or p[0] == "/")]
    best = max(fits, default=None)
    return host, path, best and best[3], default if best is None else "block" if best[2] else "allow"


def urls():
    fixed = [None, "", "no scheme.com/en/", "http://", "http://com", "http://com/", "http://COM/x", "http://www.Example.COM/en/1?x=/#y", "https://example.com/en", "http://example.com/en/", "http://badexample.com/en/", "ftp://a.www.example.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/de", "http://x.net./es/", "http://net?/es/", "http://net#a/es/", "a://b://c.net/es/", "http://é.net/fr/ü", "HTTP://User@x.net:80/es/", "http://x.net/es/\n/fr/", "http://" + "a." * 3000 + "net/es/" + "b/" * 3000, "http://..net/es/", "http://k.com/ÀB"]
    rnd = random.Random(5)
    hosts = ["com", "a.com", "b.a.com", "example.com", "www.example.com", "net", "q.net", "org", "x.org"]
    made = [f"{rnd.choice(['http', 'https'])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en', '/en/', '/es/x', '/fr/', '/e/n'])}{rnd.choice(['', '1', '/2', '?a', '#b'])}" for _ in range(300)]
    return [(i, u, "clash", 7, "n") for i, u in enumerate(fixed + made)] + [(None, "http://a.net/es/", "c", 1, None)] + [(3, "http://a.net/es/", None, None, None)] * 40


MORE = [*RULES, ("a.com", "/e", "block"), ("com", "/en", "block"), ("x.org", None, "block"), ("org", "", "allow"), ("org", "", "block"), (None, "/", "block"), ("net", "es/", "block"), ("q.net", "/", "maybe"), ("b.a.com", "/en/1", "allow"), ("a.com", "/enn", "allow"), ("", "/", "block")]


@pytest.mark.parametrize("rules", [RULES, MORE, []])
@pytest.mark.parametrize("small", [True, False])
def test_against_all_rules(spark, monkeypatch, rules, small):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 100 if small else 0)
    data = urls()
    got = url_filter.judge(spark.createDataFrame(data, SCHEMA), url_filter.rule_table(spark, rules))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    known = [r for r in rules if r[2] in ("allow", "block")]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(row[0], *plain(row[1], known)) for row in data], key=key)


def test_no_pages(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert url_filter.judge(empty, url_filter.rule_table(spark)).collect() == []


def test_plan_has_one_shuffle_and_no_python(spark):
    pages = spark.createDataFrame(urls(), SCHEMA)
    plan = url_filter.judge(pages, url_filter.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Cartesian" not in plan
