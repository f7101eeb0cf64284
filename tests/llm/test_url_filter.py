import re

import pytest

from rigflow.llm.url_filter import PATTERNS, RULES, Rule, host_rule, url_filter


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = None
    for action, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, action)
    return host, path, best


HOSTS = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
URLS = [None, "", "nothing", "https://", "http://EXAMPLE.com/en/x", "http://www.example.com/en/1?a#b", "http://a.www.example.com/en/", "http://example.com/EN/x", "http://notexample.com/en/",
        "http://x.net/es/", "http://x.net/es", "http://x.net?/es/", "http://x.net/fr/a://b", "ftp://com/", "http://com", "http://.com/", "http://a|b.com/q", "http://x.org/a\nb",
        "http://m.ads-track.example.org/en/", "http://ads.com/", "http://roads.org/", "x://net/es/://example.com/en/", "http://" + "a" * 50_000 + ".com/en/"]


def test_against_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS + URLS[:5])]
    got = {r.page_id: r for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), RULES + PATTERNS).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        host, path, best = brute(u, HOSTS)
        r = got[i]
        assert (r.host, r.path) == (host, path)
        assert r.rule == (best[0] if best else None)
        blocked = best[1] if best else "block" if re.search(r"(^|[^a-z0-9])(ads|track)([^a-z0-9]|$)", host) else "allow"
        assert r.verdict == blocked, u


def test_many_blocks_of_rules(spark, monkeypatch):
    from rigflow.llm import url_filter as module
    monkeypatch.setattr(module, "BLOCK", 2)
    urls = spark.createDataFrame([(1, "http://www.example.com/en/1"), (2, "http://x.net/fr/"), (3, None)], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter(urls, RULES).collect()}
    assert got == {1: "www.example.com/en/", 2: "net/fr/", 3: None}


def test_empty_table_clashing_columns_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string, host string")
    assert url_filter(none, RULES).count() == 0
    row = url_filter(spark.createDataFrame([(1, "http://a.com/", "kept?", "old")], "page_id long, url string, host string, verdict string"), []).collect()[0]
    assert (row.host, row.verdict) == ("a.com", "allow")


def test_rule_needs_a_token(spark):
    with pytest.raises(ValueError):
        url_filter(spark.createDataFrame([(1, "a")], "page_id long, url string"), [Rule("all", "block", ".*", ())])
    assert host_rule("block", "a-b.com", "/x/y").tokens == ("a", "b", "com", "x")


def test_plan_is_native(spark):
    plan = url_filter(spark.createDataFrame([(1, "a")], "page_id long, url string"), RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
