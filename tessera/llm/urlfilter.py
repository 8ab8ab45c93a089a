"""Judging URLs by rules and by trust and distrust in the link graph.

Rules name a host, with all its subdomains, and a path prefix; the longest
that fits decides. Other URLs are judged by their host. Trust starts at hosts
with pages that rules allow and follows links (personalised PageRank);
distrust starts at hosts with pages that rules block and follows links
backwards, to those who link there. A host's seed is the share of its pages
that rules allow or block. PageRank is linear in its seeds, so they needn't
add up to one: scores are divided by the share that teleports, and a host
without links keeps its seed as its score. A host is blocked where its
distrust exceeds its trust and reaches ``THRESHOLD``. A blocked host's distrust
is shared among all that link to it, so a single link to a host that many link
to condemns no one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import discard, persist

#: (verdict, rule); the part up to the first slash is the host.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, SETTLED, THRESHOLD = 0.85, 1e-7, 0.5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Absolute and protocol-relative links.
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""

def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ? or #, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())

def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))

def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; a block first of equals."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda x: (len(x[1]), x[0] == "block")):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict

def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of one host that link to another, each page's targets once."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1), lambda h: F.translate(h, _UPPER, _UPPER.lower())))
    pairs = pages.select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("dst")).filter("src <> '' and src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))

def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """(host, trust, distrust) from seeds of the same names along edges (src, dst, n).

    Ends when the scores are within ``settled`` of their limits: moves shrink
    by the damping each round, so those still to come add up to no more than
    damping / (1 - damping) times the last one. As all moves of a round
    together shrink at that rate, their sum at first says how many rounds
    there can be. Each round aggregates both flows by host and is written to
    the shared folder.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    shares = persist(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("down"), (F.col("n") / F.col("into")).alias("up")), "shares")
    hosts = seeds.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    zero = F.lit(0.0)
    seeded = persist(hosts.join(seeds, "host", "left").select("host", F.coalesce("trust", zero).alias("t0"), F.coalesce("distrust", zero).alias("d0")), "seeds")
    rest = 1 - damping
    state = persist(seeded.select("host", (rest * F.col("t0")).alias("trust"), (rest * F.col("d0")).alias("distrust")), "ranks")
    mass = seeded.agg(F.sum(F.col("t0") + F.col("d0"))).first()[0] or 0.0
    enough = settled * rest * rest / damping  # scores are divided by ``rest`` at the end
    for _ in range(1 + max(1, math.ceil(math.log(max(mass, 1.0) / enough) / -math.log(damping)))):
        down = shares.join(state, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("trust") * F.col("down")).alias("t"), zero.alias("d"))
        up = shares.join(state, F.col("dst") == F.col("host")).select(F.col("src").alias("host"), zero.alias("t"), (F.col("distrust") * F.col("up")).alias("d"))
        flow = down.unionByName(up).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        moved = seeded.join(flow, "host", "left").join(state.select("host", F.col("trust").alias("t_was"), F.col("distrust").alias("d_was")), "host")
        trust, distrust = (rest * F.col(s) + damping * F.coalesce(x, zero) for s, x in (("t0", "t"), ("d0", "d")))
        moved = moved.select("host", trust.alias("trust"), distrust.alias("distrust"), F.greatest(F.abs(trust - F.col("t_was")), F.abs(distrust - F.col("d_was"))).alias("change"))
        fresh = persist(moved, "ranks")
        discard(state)
        state = fresh
        if (state.agg(F.max("change")).first()[0] or 0.0) <= enough:
            break
    else:
        raise RuntimeError("the scores did not settle")
    return state.select("host", (F.col("trust") / rest).alias("trust"), (F.col("distrust") / rest).alias("distrust"))

def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url, html).

    A null URL and one without ``://`` have an empty host and path, fit no
    rule and are allowed, as nothing speaks against them; so is a host that
    neither trust nor distrust reaches. Null html has no links. Repeated rows
    are judged each and count each in their host's seed. An empty table gives
    an empty result. A very long page costs a few times its size. Also: the
    host's trust and distrust. Other columns are left out.
    """
    url = F.col("url").cast("string")
    host, path = host_of(url), path_of(url)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("says", says)
    share = lambda verdict: F.avg((F.coalesce("says", F.lit("")) == verdict).cast("double"))
    seeds = persist(judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "host-seeds")
    edges = persist(host_edges(pages.select(url.alias("url"), F.col("html").cast("string").alias("html"))), "host-edges")
    scores = propagate(seeds, edges)
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold)
    by_host = F.when(F.coalesce(bad, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("says", by_host).alias("verdict"), "trust", "distrust")
