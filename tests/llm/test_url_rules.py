"""URL rules, held against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from quarry.llm import url_rules

RULES = [("org", "/", "allow"), ("Example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("example.org", "/en/1", "allow"), ("a.example.org", "", "allow"), ("com", "/fr/", "allow"), ("com", "", "block"), (None, "/", "block"), ("", "/", "block"), ("net", "/", None), ("x.com", "/fr/ü😀", "block"), ("y.com", None, "allow")]


def judged_by_force(rows, rules, default="allow"):
    out = []
    for page, url in rows:
        rest = url.partition("://")[2] if url else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
        host = lower(raw)
        fits = [(len(h + p), len(h), v, lower(h) + p) for h, p, v in ((h, p or "", v) for h, p, v in rules if h and v) if ("." + host).endswith("." + lower(h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((page, host, path, best and best[3], best[2] if best else default))
    return Counter(out)


def pages_of(seed: int):
    rng = random.Random(seed)
    hosts = ["example.org", "a.example.org", "EXAMPLE.org", "xexample.org", "org", "b.org", "com", "www.x.com", "y.com", "com.net", "org.", ".org", "", "ÄÖ.com", "x.com:80", "u@x.com", ".".join(["l"] * 3000) + ".org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/3", "/en/2", "/fr/", "/fr/ü😀/z", "/FR/", "/de/" + "y" * 5000, "//", "/a\nb"]
    ends = ["", "?q=1", "#top", "?u=http://example.org/es/", "?", "#"]
    rows = [(i, rng.choice(["http", "https", "", "x"]) + "://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(ends)) for i in range(600)]
    rows += [(1, None), (None, "http://org/"), (None, None), (7, ""), (8, "no scheme/es/"), (9, "http:/org/"), (10, "://"), (11, "a://b://c.org/"), (12, "http://example.org"), (12, "http://example.org")]
    return rows + [(0, "https://www.example.org/en/1")] * 300


SCHEMA = "page_id long, url string, host int, path int, rule int, verdict int, n int, key int, tail int, `a.b` int"


def frames(spark, rows, rules=RULES):
    return spark.createDataFrame([(*r, *[1] * 8) for r in rows], SCHEMA), spark.createDataFrame(rules, "host string, path string, verdict string")


@pytest.mark.parametrize(("few", "hot"), [(100_000, 10_000), (2, 10), (0, 1)])
def test_judged_is_brute_force(spark, monkeypatch, few, hot):
    """With broadcast rules and addresses, and with many of both, hot and rare."""
    monkeypatch.setattr(url_rules, "BROADCAST_ROWS", few)
    monkeypatch.setattr(url_rules, "HOT_PART", hot)
    rows = pages_of(few)
    pages, rules = frames(spark, rows)
    expected = judged_by_force(rows, RULES)
    out = url_rules.judged(pages, rules)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, out.collect())) == expected
    blocked = url_rules.judged(pages, rules, default="block")
    assert Counter(map(tuple, blocked.collect())) == judged_by_force(rows, RULES, "block")
    kept = url_rules.allowed(pages, rules)
    assert kept.columns == pages.columns
    urls = dict.fromkeys(rows)
    allow = {r for r in urls if next(iter(judged_by_force([r], RULES)))[4] == "allow"}
    assert Counter((r["page_id"], r["url"]) for r in kept.collect()) == Counter(r for r in rows if r in allow)


def test_empty_tables(spark):
    pages, rules = frames(spark, [])
    assert url_rules.judged(pages, rules).count() == 0 and url_rules.allowed(pages, rules).count() == 0
    pages, rules = frames(spark, [(1, "http://a.org/")], [])
    assert [tuple(r) for r in url_rules.judged(pages, rules).collect()] == [(1, "a.org", "/", None, "allow")]


def test_query_is_its_sql_on_awkward_urls(spark, tmp_path):
    rows = [(i, u) for i, (_, u) in enumerate(pages_of(3))]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    expected = Counter(con.execute(url_rules.SQL).fetchall())
    assert Counter(map(tuple, url_rules.op13_url_rules(spark, str(tmp_path)).collect())) == expected
    assert expected == judged_by_force(rows, url_rules.RULES)
