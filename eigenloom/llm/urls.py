"""Operator 9: URL filters by rules and link-graph propagation. DataFrame functions only.

Rules (block or allow a host and its subdomains below a path) come first, the
longest that fits. Hosts that no rule decides are judged by the links between
hosts: trust starts at hosts with allowed pages and follows links (personalised
PageRank); distrust starts at hosts with blocked pages and follows links
backwards, from a site to those that link to it: a host has the damped mean
distrust of what it links to, however many others link there too. A host is
blocked where its distrust is over its trust and reaches ``BLOCK_AT``.

Edges are links of pages to other hosts, counted by pair of hosts before they
are shuffled; a relative link goes to the host of the page's ``<base>``, else to its
own. With ``name_edges`` a host and the host one label up are joined too, where both
occur. Seeds are shares: a host with a tenth of its pages blocked starts at a
tenth. A round is two equi-joins and a sum over hosts; its result is written to
the shared folder.

Defined results
    null url or none with ``://``: empty host and path, no rule, method allows;
    null html: no links; very long html is read whole; null or repeated ``page_id``
    and repeated rows: a row each, and each page's links count; of two rules as long
    that fit, the later one; distrust that only equals trust does not block; other
    columns are not read; empty table: no rows. Ports and user parts belong to the
    host as they stand.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenloom.session import join_checked, materialise, release

DAMPING = 0.85
ROUNDS = 15
#: Distrust, as a share of what a fully blocked host starts with, that blocks.
BLOCK_AT = 0.5
#: Rules are part of the plan, so their number is bounded.
MOST_RULES = 1000


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> UrlRule:
    """A rule from its verdict and a text like ``example.net/en/``."""
    host, slash, path = text.partition("/")
    return UrlRule(verdict, host, slash + path)


#: The rules of the query.
RULES = (rule("block", "net/"), rule("allow", "example.net/en/"), rule("block", "example.com/de/"), rule("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_BASE = r"""(?i)<base\b[^>]*\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are part of a plan")
    chosen = F.lit(None).cast("struct<verdict: string, rule: string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("rule"))).otherwise(chosen)
    return chosen


def linked_host(link: Column, page_host: Column, base_host: Column) -> Column:
    """Host that a link of a page goes to; empty where it names none (``mailto:`` and the like)."""
    relative = ~link.startswith("//") & ~link.rlike(_SCHEME)
    full = F.when(link.startswith("//"), F.concat(F.lit("x:"), link)).otherwise(link)
    return F.when(relative, F.when(base_host != "", base_host).otherwise(page_host)).otherwise(host_of(full))


def host_edges(pages: DataFrame, hosts: DataFrame, name_edges: bool = True) -> DataFrame:
    """(src, dst, n) between different hosts: links of pages, and neighbours in the tree of names."""
    html = F.coalesce("html", F.lit(""))
    base = F.regexp_extract(html, _BASE, 1)
    base_host = host_of(F.when(base.startswith("//"), F.concat(F.lit("x:"), base)).otherwise(base))
    targets = F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1))))
    linked = pages.select(host_of(F.col("url")).alias("src"), base_host.alias("base"), targets.alias("link"))
    every = linked.select("src", linked_host(F.col("link"), F.col("src"), F.col("base")).alias("dst"))
    if name_edges:
        names = hosts.select("host").filter("host <> ''")
        up = names.select("host", F.expr("substring(host, locate('.', host) + 1)").alias("above")).filter("above <> host")
        above = up.join(names.select(F.col("host").alias("above")), "above")
        tree = above.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("above").alias("dst")), F.struct(F.col("above").alias("src"), F.col("host").alias("dst")))).alias("e"))
        every = every.unionByName(tree.select("e.src", "e.dst"))
    return every.filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, *, damping: float = DAMPING, rounds: int = ROUNDS, back_by: str = "dst") -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, trust, distrust) over ``edges`` (src, dst, n).

    A host hands its trust to those it links to by their share of its links.
    With ``back_by`` "dst" it hands its distrust to those that link to it by
    their share of these links, so many linkers get little each; with "src" a
    linker takes it by the share of its own links that go there. In units of
    what a seed of 1 keeps for itself.
    """
    if back_by not in ("src", "dst"):
        raise ValueError(f"back_by is src or dst, not {back_by}")
    out = edges.groupBy("src").agg(F.sum("n").alias("n_out"))
    shares = edges.join(out, "src").withColumn("forward", F.col("n") / F.col("n_out"))
    if back_by == "dst":
        into = edges.groupBy("dst").agg(F.sum("n").alias("n_in"))
        shares = shares.join(into, "dst").withColumn("back", F.col("n") / F.col("n_in"))
    else:
        shares = shares.withColumn("back", F.col("forward"))
    shares = shares.select("src", "dst", "forward", "back")
    shares = materialise(shares, "url-edges")
    ends = shares.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    zero = F.lit(0.0)
    known = seeds.select("host", "trust", "distrust").unionByName(ends.select("host", zero.alias("trust"), zero.alias("distrust")))
    base = materialise(known.groupBy("host").agg(F.sum("trust").alias("seed_trust"), F.sum("distrust").alias("seed_distrust")), "url-seeds")
    state = base.select("host", F.col("seed_trust").alias("trust"), F.col("seed_distrust").alias("distrust"))
    if shares.isEmpty():
        return state
    last = None
    for _ in range(rounds):
        ahead = shares.join(state, shares["src"] == state["host"]).select(F.col("dst").alias("to"), (F.col("trust") * F.col("forward")).alias("trust"), zero.alias("distrust"))
        behind = shares.join(state, shares["dst"] == state["host"]).select(F.col("src").alias("to"), zero.alias("trust"), (F.col("distrust") * F.col("back")).alias("distrust"))
        got = ahead.unionByName(behind).groupBy("to").agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"))
        joined = base.join(got, base["host"] == got["to"], "left")
        step = lambda seed, sent: F.col(seed) + damping * F.coalesce(F.col(sent), zero)
        state = materialise(joined.select("host", step("seed_trust", "t").alias("trust"), step("seed_distrust", "d").alias("distrust")), "url-scores")
        if last is not None:
            release(last)
        last = state
    return state


def filter_urls(pages: DataFrame, rules=RULES, *, damping: float = DAMPING, rounds: int = ROUNDS, block_at: float = BLOCK_AT, name_edges: bool = True) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page of a table (page_id, url, html)."""
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("by_rule", rule_for(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("by_rule.verdict") == verdict, 1.0).otherwise(0.0))
    hosts = materialise(judged.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "url-hosts")
    scores = propagate(hosts, host_edges(pages, hosts, name_edges), damping=damping, rounds=rounds, back_by="src")
    scores = scores.select(F.col("host").alias("of_host"), "trust", "distrust")
    full = join_checked(judged, scores, judged["host"] == scores["of_host"], "left")
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= block_at) & (F.col("host") != "")
    method = F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))
    return full.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce(F.col("by_rule.verdict"), method).alias("verdict"), "trust", "distrust")
