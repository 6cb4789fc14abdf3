"""Operator 3: URL filter by rules and link-graph propagation, in DataFrame operations alone.

A url is judged by the longest rule that fits it. Where none fits, its host is judged by two
personalised PageRanks over the edges between hosts: trust flows along links from the hosts
that allow rules favour, distrust flows against links from the hosts that block rules condemn.
A host that only rules of one verdict name is a full seed of it; any other is a seed by the
share of its known urls, its pages and the links to it, whose longest rule has the verdict. A
host is blocked if its distrust, less its trust, exceeds ``threshold``. There, a seed by share
counts for others alone: its rules have judged their own urls and say nothing of the rest.

Edges are counted per pair of hosts before anything is shuffled further, so a hot host costs a
row per partner, not per link. Every second iteration is written to the shared folder, which
cuts the lineage, and compared with the one before it, until the ranks have settled.

Defined results: null urls and urls without ``://`` have an empty host and path, fit no rule
and are allowed; null or empty html has no links; repeated rows are judged each; empty tables
give empty results; a host without a path of links to a seed is allowed. Links that begin with
``//`` count like absolute ones; all others lead to their own host and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, only, stored

#: verdict, host, path of the production rules
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?is)<a\s[^<>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
SETTLED = 1e-4  # of a rank, in two rounds


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def in_domain(host: Column, domain: str) -> Column:
    """Whether a host is the domain or below it."""
    return (host == domain) | host.endswith(f".{domain}")


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = in_domain(host, domain) & path.startswith(start)
        text, verdict = F.when(fits, domain + start).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def verdict_counts() -> list[Column]:
    """Aggregates of urls judged by rule: how many, and how many of each verdict."""
    return [F.count("*").alias("links"), *[F.count(F.when(F.col("by_rule") == v, 1)).alias(v) for v in ("allow", "block")]]


def host_links(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """src, dst, links, allow, block: how many absolute links of the pages of one host lead to another or to itself, and how many of their targets a rule allows or blocks."""
    links = only(pages, "url", "html").select(url_host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1))).alias("to"))
    links = links.select("src", F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to")).alias("to"))
    targets = links.select("src", url_host(F.col("to")).alias("dst"), url_path(F.col("to")).alias("path")).where("dst != ''")
    return targets.withColumn("by_rule", longest_rule(F.col("dst"), F.col("path"), rules)[1]).groupBy("src", "dst").agg(*verdict_counts())


def propagate(edges: DataFrame, hosts: DataFrame, seed: Column, source: str, target: str, rounds: int | None, damping: float, label: str) -> DataFrame:
    """host, seed, rank: personalised PageRank with restarts at the hosts by their ``seed``; of ``rounds`` rounds, or until it has settled."""
    nodes = stored(hosts.select("host", seed.alias("seed")), f"{label}-seeds")
    rank = nodes.select("host", "seed", F.col("seed").alias("rank"))
    if edges.isEmpty():  # nothing flows: any number of rounds gives this
        return rank if rounds == 0 else nodes.select("host", "seed", ((1 - damping) * F.col("seed")).alias("rank"))
    out = edges.groupBy(F.col(source).alias("host")).agg(F.sum("links").alias("all_links"))
    shares = edges.join(out, edges[source] == out["host"]).select(F.col(source).alias("a"), F.col(target).alias("b"), (F.col("links") / F.col("all_links")).alias("share"))
    shares = stored(shares, f"{label}-shares")
    before, done, change = rank, 0, 1.0
    while done < rounds if rounds is not None else change > SETTLED:
        for _ in range(2 if rounds is None else min(2, rounds - done)):
            inflow = shares.join(rank, shares["a"] == rank["host"]).groupBy(F.col("b").alias("to")).agg(F.sum(F.col("share") * F.col("rank")).alias("inflow"))
            rank = nodes.join(inflow, nodes["host"] == inflow["to"], "left").select("host", "seed", ((1 - damping) * F.col("seed") + damping * F.coalesce(F.col("inflow"), F.lit(0.0))).alias("rank"))
            done += 1
        rank = stored(rank, f"{label}-{done}")
        if rounds is None:
            was = before.select(F.col("host").alias("was_host"), F.col("rank").alias("was"))
            change = rank.join(was, F.col("host") == F.col("was_host")).agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
            before = rank
    return rank


def host_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, rounds: int | None = None, damping: float = 0.85, threshold: float = 0.01) -> DataFrame:
    """host, trust, distrust, host_verdict of every host that a page has or that a page links to."""
    links = stored(host_links(pages, rules), "links")
    edges = links.where("src != '' AND src != dst").select("src", "dst", "links")
    own = only(pages, "url").select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).where("host != ''")
    own = own.withColumn("by_rule", longest_rule(F.col("host"), F.col("path"), rules)[1]).groupBy("host").agg(*verdict_counts())
    linked = links.groupBy(F.col("dst").alias("host")).agg(*[F.sum(n).alias(n) for n in ("links", "allow", "block")])
    hosts = own.union(linked).groupBy("host").agg(*[F.sum(n).alias(n) for n in ("links", "allow", "block")])

    def named(kind: str) -> Column:
        other = "block" if kind == "allow" else "allow"
        domains = lambda k: reduce(lambda a, b: a | b, [in_domain(F.col("host"), d) for v, d, _ in rules if v == k], F.lit(False))
        return domains(kind) & ~domains(other)

    def seed(kind: str) -> Column:
        return F.when(named(kind), 1.0).otherwise(F.col(kind) / F.col("links"))

    def ranks(kind: str, source: str, target: str, name: str) -> DataFrame:
        """host, the rank, and what of it judges the host itself: all but the restarts of a seed by share."""
        rank = propagate(edges, hosts, seed(kind), source, target, rounds, damping, name)
        restart = (1.0 if rounds == 0 else 1 - damping) * F.col("seed")
        return rank.select("host", F.col("rank").alias(name), F.when(named(kind), F.col("rank")).otherwise(F.col("rank") - restart).alias(f"{name}_here"))

    hosts = stored(hosts, "hosts")
    trust, distrust = ranks("allow", "src", "dst", "trust"), ranks("block", "dst", "src", "distrust")
    verdict = F.when(F.col("distrust_here") - F.col("trust_here") > threshold, "block").otherwise("allow")
    return trust.join(distrust, "host").select("host", "trust", "distrust", verdict.alias("host_verdict"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, **how: float) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each row of ``pages``."""
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = only(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    ranks = host_verdicts(pages, rules, **how)
    return rows.join(ranks, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "host_verdict", F.lit("allow")).alias("verdict"), "trust", "distrust")
