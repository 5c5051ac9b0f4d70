"""URL filters against plain Python, with aliases over redirects and canonical links."""
import random

import duckdb
from pyspark.sql import functions as F

from tessera.llm import url_filter
from tessera.llm.registry import ORACLE_SQL, URL_RULES, op13_url_filter

SCHEMA = "page_id long, url string, html string"


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:at], rest[at:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return host, tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def own_rule(url, rules):
    host, path = split(url)
    fit = [(len(r), r, v) for v, r in rules for h, _, p in [r.partition("/")]
           if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fit)[1:] if fit else (None, None)


def brute(urls, edges, rules):
    """The verdict of each URL by flooding from every blocked one."""
    key = lambda u: (u.split("#")[0].split("://", 1)[0].lower(), split(u)[0], u.split("#")[0].split("://", 1)[1][len(split(u)[0]):])
    near, blocked = {}, set()
    for a, b in edges:
        for x in (a, b):
            if own_rule(x, rules)[1] == "block":
                blocked.add(key(x))
        near.setdefault(key(a), set()).add(key(b))
        near.setdefault(key(b), set()).add(key(a))
    todo = list(blocked)
    while todo:
        for x in near.get(todo.pop(), ()):
            if x not in blocked:
                blocked.add(x)
                todo.append(x)
    out = []
    for u in urls:
        rule, verdict = own_rule(u, rules)
        hit = bool(u) and "://" in u and key(u) in blocked
        out.append((*split(u), rule, verdict or ("block" if hit else "allow")))
    return out


def judged(spark, rows, rules=URL_RULES, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rule", F.lit("own")).withColumn("key", F.lit(1))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules, **kw).collect()}


def test_table_matches_plain_python(spark, sf):
    rows = duckdb.sql(f"SELECT page_id, url FROM read_parquet('{sf}/pages.parquet')").fetchall()
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in op13_url_filter(spark, sf).collect()), key=str)
    want = brute([u for _, u in rows], [], URL_RULES)
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    rel = con.sql(ORACLE_SQL["op13_url_filter"])
    assert rel.columns == ["page_id", "host", "path", "rule", "verdict"] and sorted(rel.fetchall(), key=str) == got


def test_odd_urls(spark, sf):
    urls = [None, "", "no scheme", "http://ORG", "http://org/", "http://a.Org/x?y#z", "http://xorg/", "a://b://example.org/es/",
            "http://example.org?/es/", "HTTP://Sub.Example.ORG/es/1", "http://example.org/en/19", "http://com/fr/", "http://é.com/de/\nx",
            "http://a.com/fr", "http:///de/", "http://example.org#/es/", "http://org/", "http://notexample.org/es/"]
    got = judged(spark, [(i, u, None) for i, u in enumerate(urls)])
    assert [got[i] for i in range(len(urls))] == brute(urls, [], URL_RULES)
    assert judged(spark, []) == {}
    assert judged(spark, [(1, "http://com/de/", "")], rules=[]) == {1: ("com", "/de/", None, "allow")}


def test_aliases_of_a_blocked_url(spark, sf):
    link = '<html><head><link data-x="1" rel="alternate Canonical" href="{}"></head>'.format
    meta = "<META http-equiv='Refresh' content=\"0; URL='{}'\">".format
    rows = [(1, "http://a.net/1", link("http://b.net/1?x=1&amp;y=2")),      # 1 - b - block
            (2, "http://b.net/1?x=1&y=2#top", meta("https://m.com/de/1")),
            (3, "https://m.com/de/1", None),
            (4, "http://c.net/d/e", meta("../1")),                              # 4 - c.net/1, nothing blocked
            (5, "http://x.org/1", link("http://A.NET/1")),                     # explicit allow beside blocked aliases
            (6, "http://c.net/f", "<!-- " + link("http://a.net/1") + " --><script>'" + link("http://a.net/1") + "'</script>"),
            (7, "http://d.net/", '<base href="http://a.net/"><link rel=canonical href=1>'),
            (8, "http://e.net/", '<link rel=canonical><meta http-equiv=refresh content="5"><link rel=canonical href="http://[x">'),
            (9, None, link("http://a.net/1")), (10, "http://a.net/1", None), (10, "http://a.net/1", None)]
    got = judged(spark, rows)
    assert {i: v[3] for i, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block",
                                                 8: "allow", 9: "allow", 10: "block"}
    assert got[5][2] == "org/" and got[1][2] is None


def test_random_edges_match_flooding(spark, sf):
    rng = random.Random(5)
    urls = [f"http://h{i}.{rng.choice(['net', 'com', 'org', 'example.org'])}/{rng.choice(['fr', 'de', 'en', 'es'])}/{i}" for i in range(300)]
    edges = [(rng.choice(urls), rng.choice(urls)) for _ in range(140)] + [(u, urls[0]) for u in urls[200:]] + [(urls[3], urls[3])]
    got = judged(spark, [(i, u, None) for i, u in enumerate(urls)], edges=spark.createDataFrame(edges, "src string, dst string"))
    want = brute(urls, edges, URL_RULES)
    assert [got[i] for i in range(len(urls))] == want
    assert len({w[3] for w in want}) == 2 and any(w[2] is None and w[3] == "block" for w in want)
    none = judged(spark, [(1, "http://a.net/", None)], edges=spark.createDataFrame([], "src string, dst string"))
    assert none == {1: ("a.net", "/", None, "allow")}
