"""Rules, and propagation over a small link graph against plain Python."""

from pyspark.sql import functions as F

from locuskit.llm import url_filter


def link(host):
    return f'<a class=x href="https://{host}/p">x</a><a href="/own">y</a>'


def plain_scores(edges, seeds, rounds=200, d=url_filter.DAMPING):
    out = {}
    for h, t, n in edges:
        out.setdefault(h, []).append((t, n))
    seeds = {h: w / sum(seeds.values()) for h, w in seeds.items()}
    s = dict(seeds)
    for _ in range(rounds):
        kept = sum(x for h, x in s.items() if h not in out)
        new = {h: w * (1 - d + d * kept) for h, w in seeds.items()}
        for h, to in out.items():
            for t, n in to:
                new[t] = new.get(t, 0) + d * s.get(h, 0) * n / sum(k for _, k in to)
        s = new
    return s


def test_verdicts(spark):
    pages = [
        (1, "https://good.org/a", link("friend.net") + link("friend.net")), (2, "http://X.com/de/1", link("neutral.net")), (3, "http://farm.net/z", link("x.com") + link("FRIEND.net")), (4, "https://friend.net/q?u=1", None),
        (5, "https://neutral.net#f", ""), (6, None, link("x.com")), (7, "no scheme", "x"), (8, "http://a.example.org/es/9", ""), (9, "http://example.org/en/12", ""), (10, "http://example.org", ""), (11, "http://org/en/1", ""),
        (12, "http://notexample.org/es/", ""), (13, "http://farm.net/z", link("x.com")), (14, "http://u:p@H.COM:80/fr/x?y", ""), (None, "http://lone.net/", "<a href=//lone.net/x>"),
    ]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, host string")
    got = {r.id: r for r in url_filter.judge(df).collect()}
    want = {1: ("org/", "allow"), 2: ("com/de/", "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("example.org/es/", "block"), 9: ("example.org/en/1", "block"), 10: (None, "block"), 11: ("org/", "allow"), 12: ("org/", "allow"), 13: (None, "block"), 14: (None, "allow"), None: (None, "allow")}
    assert (got[14].host, got[14].path) == ("u:p@h.com:80", "/fr/x") and (got[5].host, got[5].path) == ("neutral.net", "") and (got[7].host, got[7].path) == ("", "")
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == want
    assert url_filter.judge(df.limit(0)).collect() == []


def test_propagation_equals_plain_loops(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 3), ("c", "a", 1), ("d", "a", 5), ("b", "sink", 1)]
    seeds = {"a": 1.0, "d": 0.5}
    total = {h: sum(n for x, _, n in edges if x == h) for h, _, _ in edges}
    e = spark.createDataFrame([("trust", h, t, n / total[h]) for h, t, n in edges], "kind string, src string, dst string, share double")
    s = spark.createDataFrame([("trust", h, w) for h, w in seeds.items()], "kind string, host string, weight double")
    got = {r.host: r.score for r in url_filter.propagate(e, s).collect()}
    want = plain_scores(edges, seeds)
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-5 for h in want) and abs(sum(got.values()) - 1) < 1e-9


def test_many_trusted_hosts_dont_outweigh_few_blocked_ones(spark):
    pages = [(i, f"http://t{i}.org/", link("far.net")) for i in range(50)] + [(100, "http://x.com/de/", ""), (101, "http://farm.net/", link("x.com")), (102, "http://far.net/", "")]
    got = {r.id: r.verdict for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[101] == "block" and got[102] == "allow"


def test_very_long_page_and_clashing_columns(spark):
    """A page of thirty thousand links counts each; columns may be called like the operator's own."""
    page = link("good.net") * 15_000 + link("x.com") * 15_000 + "<p>" + "z" * 1_000_000
    pages = [(1, "https://long.net/", page, 1, "n", False), (2, "https://a.org/", link("long.net"), 2, None, True), (3, "http://x.com/de/", "", 3, "m", None), (4, "http://" + "h" * 100_000 + ".net/", None, 4, "", True)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, id int, links string, by_rule boolean").withColumnsRenamed({"id": "host"}).withColumn("rule", F.lit("r"))
    got = {r.id: (r.verdict, r.rule) for r in url_filter.judge(df).collect()}
    assert got[2] == ("allow", "org/") and got[3] == ("block", "com/de/") and got[1][1] is None and got[4] == ("allow", None)
