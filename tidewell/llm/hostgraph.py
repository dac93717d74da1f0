"""URL filtering by rules and by trust and distrust along links between hosts.

Where no rule fits a page, its host decides. Trust starts at hosts that an allowing rule fits and flows
along links (personalised PageRank); distrust starts at hosts that are blocked whole and flows against
them, to the hosts that link there. A host is blocked if its distrust is over a floor and over a
multiple of its trust.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): fits the host and its subdomains where the URL's path begins with the path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Targets of links with a host of their own; relative links stay on their page's host.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare(host: Column) -> Column:
    """A host without user and port: what a node of the graph is named by."""
    return F.regexp_replace(host, r"^[^@]*@|:\d*$", "")


def fits(host: Column, rule_host: str) -> Column:
    return (host == rule_host) | host.endswith(f".{rule_host}")


def ruled(pages: DataFrame, rules: list) -> DataFrame:
    """Adds host, path and the longest rule that fits, with its verdict; null where none does."""
    pages = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    cases = [(fits(F.col("host"), h) & F.col("path").startswith(p), h + p, v) for v, h, p in by_length]
    first = lambda k: F.coalesce(*(F.when(c[0], F.lit(c[k])) for c in cases), F.lit(None).cast("string"))
    return pages.withColumn("rule", first(1)).withColumn("by_rule", first(2))


def host_scores(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) from hosts (host, trusted, blocked: 0 or 1) and edges (src, dst, n).

    Rounds go on until no host's ranks change by `tolerance`. The sum of both changes is 4 at first at
    most and shrinks by `damping` each round, which gives the limit of rounds where none is given.
    """
    if rounds is None:
        rounds = max(1, math.ceil(math.log(tolerance / 4) / math.log(damping)) + 1)
    totals = hosts.agg(F.sum("trusted"), F.sum("blocked")).first()
    share = lambda c, total: F.col(c) / F.lit(float(total or 1))
    seeds = stored(hosts.select("host", share("trusted", totals[0]).alias("seed_t"), share("blocked", totals[1]).alias("seed_d")), "seeds")
    out_n = edges.groupBy("src").agg(F.sum("n").alias("out_n"))
    in_n = edges.groupBy("dst").agg(F.sum("n").alias("in_n"))
    links = stored(edges.join(out_n, "src").join(in_n, "dst").select("src", "dst", (F.col("n") / F.col("out_n")).alias("along"), (F.col("n") / F.col("in_n")).alias("against")), "links")
    ranks = seeds.select("host", F.col("seed_t").alias("trust"), F.col("seed_d").alias("distrust"))
    if links.isEmpty():
        return ranks
    for _ in range(rounds):
        trust = links.join(ranks, links.src == ranks.host).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("along") * F.col("trust")).alias("flow_t"))
        distrust = links.join(ranks, links.dst == ranks.host).groupBy(F.col("src").alias("host")).agg(F.sum(F.col("against") * F.col("distrust")).alias("flow_d"))
        new = seeds.join(trust, "host", "left").join(distrust, "host", "left").select("host", ((1 - damping) * F.col("seed_t") + damping * F.coalesce("flow_t", F.lit(0.0))).alias("trust"), ((1 - damping) * F.col("seed_d") + damping * F.coalesce("flow_d", F.lit(0.0))).alias("distrust"))
        new = stored(new, "ranks")
        moved = new.join(ranks.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d")), "host").agg(F.max(F.abs(F.col("trust") - F.col("t")) + F.abs(F.col("distrust") - F.col("d")))).first()[0]
        if _:
            discard(ranks)
        ranks = new
        if moved < tolerance:
            break
    return ranks


def judged(pages: DataFrame, rules: list = RULES, floor: float = 0.1, ratio: float = 1.0) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    Trusted seeds are hosts that an allowing rule fits, blocked seeds those that a blocking rule for all
    paths fits. `floor` is a share of the mean over hosts; ranks are
    iterated until they change by less than a hundredth of it. Only counts for each pair of hosts are
    shuffled; a host with many pages is joined, never gathered. Null urls and urls without `://`: host and
    path empty, no rule, allowed. In the graph hosts count without user and port. Null html: no links.
    Very long html: its links become rows one by one, of which only counts for pairs of hosts are kept.
    Repeated rows: each is judged, and its links count. An empty table: no rows. Other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = pages.select(bare(host_of(F.col("url"))).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", F.translate(bare(F.col("dst")), UPPER, LOWER).alias("dst"))
    edges = stored(links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")), "edges")
    own = pages.select(bare(host_of(F.col("url"))).alias("host")).where("host <> ''").distinct()
    known = own.unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    any_of = lambda which: F.greatest(F.lit(0), *(F.when(fits(F.col("host"), h), 1).otherwise(0) for v, h, p in rules if which(v, p)), F.lit(0))
    blocked = any_of(lambda v, p: v == "block" and p == "/")
    hosts = stored(known.withColumn("blocked", blocked).withColumn("trusted", F.when(F.col("blocked") == 0, any_of(lambda v, p: v == "allow")).otherwise(0)), "hosts")
    many = max(1, hosts.count())
    scores = host_scores(hosts, edges, tolerance=max(0.01 * floor / many, 1e-15))
    bad = scores.withColumn("bad", (F.col("distrust") > floor / many) & (F.col("distrust") > ratio * F.col("trust")))
    out = ruled(pages.select("page_id", "url"), rules).withColumn("node", bare(F.col("host"))).join(bad.withColumnRenamed("host", "node"), "node", "left")
    verdict = F.coalesce("by_rule", F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
