import pytest

from tessera.llm import urlfilter


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    best = None
    for says, rule in urlfilter.RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = rule, says
    return best or (None, None)


def plain_verdicts(pages):
    split = [(plain_host_path(u), html) for _, u, html in pages]
    hosts = {}
    for (h, p), _ in split:
        if h:
            hosts.setdefault(h, []).append(plain_rule(h, p)[1])
    edges = {}
    import re

    for (h, _), html in split:
        for dst in {m.lower() for m in re.findall(urlfilter._LINK, html or "")}:
            if h and dst != h:
                edges[h, dst] = edges.get((h, dst), 0) + 1
    names = set(hosts) | {x for e in edges for x in e}
    t0 = {h: hosts.get(h, []).count("allow") / max(1, len(hosts.get(h, []))) for h in names}
    d0 = {h: hosts.get(h, []).count("block") / max(1, len(hosts.get(h, []))) for h in names}
    out = {h: sum(n for (a, _), n in edges.items() if a == h) for h in names}
    into = {h: sum(n for (_, b), n in edges.items() if b == h) for h in names}
    t, d = dict(t0), dict(d0)
    for _ in range(100):
        nt = {h: t0[h] + 0.85 * sum(t[a] * n / out[a] for (a, b), n in edges.items() if b == h) for h in names}
        nd = {h: d0[h] + 0.85 * sum(d[b] * n / into[b] for (a, b), n in edges.items() if a == h) for h in names}
        t, d = nt, nd
    verdicts = []
    for (h, p), _ in split:
        rule, says = plain_rule(h, p)
        bad = h in names and d[h] > t[h] and d[h] >= urlfilter.THRESHOLD
        verdicts.append((h, p, rule, says or ("block" if bad else "allow")))
    return verdicts


PAGES = [
    (1, "http://WWW.Example.com/en/x", None),
    (2, "https://a.example.com/en/1?x=/y", '<a href="http://spam.net/es/">'),
    (3, "http://spam.net/es/1", ""),
    (4, "http://spam.net/fr/2", '<a HREF=\'//Mirror.org/p\'>'),
    (5, "http://spam.net/de/2", None),
    (6, "http://farm.org/q#/es/", '<a href="https://spam.net/es/2"><a href="/local">'),
    (7, "http://farm.org", '<a href="http://spam.net">'),
    (8, "http://good.com/", '<a href="http://friend.org/">'),
    (9, "http://friend.org/a", None),
    (10, "no url", "x"),
    (11, None, None),
    (12, "http://net/es/", ""),
    (13, "http://notnet.xnet/es/", ""),
    (14, "http://mirror.org/z", ""),
    (15, "http://a.com?x", ""),
    (15, "http://a.com?x", ""),
    (16, "x://://b.net/es/", ""),
]


def check(df, pages):
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urlfilter.judge(df).collect())
    want = sorted((i, h, p, r or "", v) for (i, _, _), (h, p, r, v) in zip(pages, plain_verdicts(pages), strict=True))
    assert got == want


def test_small_graph(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'clash' as host", "'clash' as rule", "1 as trust")
    check(df, PAGES)
    verdict = {r.page_id: r.verdict for r in urlfilter.judge(df, threshold=0.3).collect()}
    assert verdict[5] == "block"  # its host's other pages are blocked
    assert verdict[6] == verdict[7] == "block"  # they link to a blocked host
    assert verdict[9] == "allow" and verdict[10] == "allow"


def test_scores_of_a_ring_are_at_their_limit(spark):
    """a -> b -> c -> a, trust from a, distrust from c: the limits have closed forms."""
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 1.0)], "host string, trust double, distrust double")
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 1), ("c", "a", 2)], "src string, dst string, n long")
    got = {r.host: (r.trust, r.distrust) for r in urlfilter.propagate(seeds, edges).collect()}
    d = 0.85
    whole = 1 / (1 - d**3)
    want = {"a": (whole, d * d * whole), "b": (d * whole, d * whole), "c": (d * d * whole, whole)}
    for host in "abc":
        assert got[host] == pytest.approx(want[host], abs=1e-6)


def test_all_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    check(df, [(r.page_id, r.url, r.html) for r in df.collect()])


def test_empty(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("url,host,path", [("HTTP://A.b/C?d#e", "a.b", "/C"), ("x://y#z/", "y", ""), ("a/b", "", ""), ("é://ÀB/ü\n?", "Àb", "/ü\n")])
def test_parts(spark, url, host, path):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(url,)], "u string").select(urlfilter.host_of(F.col("u")).alias("h"), urlfilter.path_of(F.col("u")).alias("p")).first()
    assert (r.h, r.p) == (host, path) == plain_host_path(url)
