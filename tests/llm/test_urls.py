from __future__ import annotations

import re

from airlume.llm.queries import RULES
from airlume.llm.urls import Rule, judge

URLS = [
    None, "", "no scheme", "http://", "https://Www.Example.COM/en/1?x=/fr/", "http://a.example.com/en/5#x", "http://example.com/EN/1",
    "http://notexample.com/en/2", "http://x.net/es/1", "http://net/fr/", "http://x.net/fr", "ftp://a://b/c", "http://h.org?x=1", "http://ünï.ORG/p/ä",
    "http://example.org:80/a b/1", "http://a.com#f/en/",
]


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def _rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, _n string")


def test_rules_and_parts(spark):
    rows = [*enumerate(URLS), (None, URLS[5]), (5, URLS[5])]
    got = judge(_pages(spark, rows), RULES).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got if r.page_id is not None}
    for i, url in enumerate(URLS):
        host, path = _parts(url)
        rule = _rule(host, path)
        assert (by_id[i].host, by_id[i].path) == (host, path)
        assert by_id[i].rule == (rule.text if rule else None)
        assert by_id[i].verdict == (("allow" if rule.allow else "block") if rule else by_id[i].verdict)
        assert by_id[i].verdict in ("allow", "block")
    assert judge(_pages(spark, []), RULES).count() == 0


def test_templates_learn_from_ruled_urls(spark):
    rules = [Rule("a.io", "/shop/1", False), Rule("a.io", "/news/1", True)]
    rows = [(i, f"http://a.io/{kind}/{first}{i}.html") for k, kind in enumerate(("shop", "news")) for first in (1, 2) for i in range(1000 * k + 100 * first, 1000 * k + 100 * first + 40)]
    got = judge(_pages(spark, rows), rules).collect()
    assert {(r.path[1:5], r.verdict) for r in got} == {("shop", "block"), ("news", "allow")}
    assert {r.template for r in got} == {"a.io/shop/*.html", "a.io/news/*.html"}


def test_many_children_and_like_branches_become_wildcards(spark):
    rows = [(i, f"http://b.io/user-{chr(97 + i % 26)}{chr(97 + i // 26)}/page") for i in range(60)]
    got = judge(_pages(spark, rows), [Rule("b.io", "/user-a", False)]).collect()
    assert {r.template for r in got} == {"b.io/*/page"}
    rows = [(i, f"http://c.io/{'pq'[i % 2]}/x{i}") for i in range(40)]
    rules = [Rule("c.io", "/p/x1", True), Rule("c.io", "/p/", True), Rule("c.io", "/q/", True)]
    assert {r.template for r in judge(_pages(spark, rows), rules).collect()} == {"c.io/*/*"}


def test_a_branch_that_differs_stays_among_many(spark):
    ads = [f"http://d.io/ads/{w}{k}" for k in range(300) for w in ("x", "y")]
    others = [f"http://d.io/{chr(97 + i % 26)}{chr(97 + i // 26)}-word/{w}{k}" for i in range(40) for k in range(4) for w in ("x", "y")]
    got = judge(_pages(spark, list(enumerate(ads + others))), [Rule("d.io", "/ads/x", False), *(Rule("d.io", u[len("http://d.io") :], True) for u in others if "/x" in u)]).collect()
    assert {(r.path.startswith("/ads/"), r.verdict) for r in got} == {(True, "block"), (False, "allow")}
    assert {r.template for r in got if r.path.startswith("/ads/")} == {"d.io/ads/*"}


def test_a_variable_child_that_differs_is_not_merged_with_its_siblings(spark):
    rows = [f"http://e.io/{1000 + i}/{w}" for i in range(300) for w in ("x", "y")]
    rows += [f"http://e.io/{chr(97 + i % 26)}{chr(97 + i // 26)}/{w}" for i in range(40) for w in ("y", "z")]
    rules = [Rule("e.io", f"/{d}", False) for d in range(1, 10)] + [Rule("e.io", f"/{chr(97 + i)}a/y", True) for i in range(20)]
    got = judge(_pages(spark, list(enumerate(rows))), rules).collect()
    assert {r.template.split("/")[1] for r in got if r.path[1].isdigit()} == {"*"}
    assert not {r.template.split("/")[1] for r in got if not r.path[1].isdigit()} & {"*"}


def test_branches_that_part_far_down_stay_apart(spark):
    rows = [f"http://f.io/a/b/c/d/e/{kind}/{w}{k}" for kind in ("ads", "news") for k in range(40) for w in ("x", "y")]
    rows += ["http://f.io/a", "http://f.io/" + "/".join("z" * k for k in range(1, 20))]
    rules = [Rule("f.io", "/a/b/c/d/e/ads/x", False), Rule("f.io", "/a/b/c/d/e/news/x", True)]
    got = judge(_pages(spark, list(enumerate(rows))), rules).collect()
    assert len(got) == len(rows)
    assert {(r.path[11:14], r.verdict, r.template) for r in got if "/e/" in r.path} == {
        ("ads", "block", "f.io/*/b/c/d/e/ads/*"), ("new", "allow", "f.io/*/b/c/d/e/news/*")
    }


def test_siblings_without_labels_never_flip_a_verdict(spark):
    def verdicts(more):
        rows = [f"http://z.io/{d}/{w}" for d in ("ads", "shop", "news") for w in ("x", "y", "w1", "w2")]
        rows += ["http://z.io/uaa/x", "http://q.io/lone/x", "http://q.io/lone/y", "http://r.io/shop/z"]
        known = len(rows)
        rows += [f"http://{h}.io/u{chr(97 + i % 26)}{chr(98 + i // 26)}/{w}" for h in "zqr" for i in range(more) for w in "xz"]
        rules = [Rule("z.io", "/ads/", False), Rule("z.io", "/shop/w", False), Rule("z.io", "/news/", True), Rule("q.io", "/lone/x", True)]
        got = {r.page_id: (r.verdict, round(r.share, 9)) for r in judge(_pages(spark, list(enumerate(rows))), rules).collect()}
        return {i: got[i] for i in range(known)}

    few = verdicts(0)
    for more in (1, 26, 27, 40):
        assert verdicts(more) == few, more
