"""URL filters with link-graph propagation.

Rules decide the urls that they fit. The other urls go by their host: trust
spreads from hosts whose pages rules allow along links (personalised PageRank),
distrust from hosts whose pages rules block against the direction of links, and
a host whose distrust exceeds its trust by more than a threshold is blocked.

Both are numbers from 0 to 1 that do not depend on the size of the graph. Trust
is the share of a host's PageRank that comes from trusted seeds: the mass of a
PageRank that starts at the seeds over that of one that starts everywhere.
Distrust is what a host has of its own, and of the rest the damped mean of the
hosts that its links lead to: a host that links to nothing but a blocked one has
0.85, however many do; one with half of its links to blocked ones half of that;
and a blocked host keeps its own whoever links to it.

A host's seed is the share of its pages that a rule allows, or blocks, so a rule
on a small part of a host does not condemn the rest. A host without links keeps
its mass. Links are the absolute (or protocol-relative) addresses of ``a`` and
``area`` elements outside of comments, scripts and style sheets; a ``<`` within
a tag ends the search for its address. Links of a host to itself say nothing and
are left out; relative links count as such even where a ``base`` element leads
elsewhere.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed unless its links condemn the empty host; a null page
text has no links; repeated rows count as often as they occur; of rules of equal
length that fit the last in order of verdict and text wins; pages of any length
are searched whole; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut

DAMPING, ROUNDS, CUT_EVERY, THRESHOLD = 0.85, 20, 5, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is no part of the page, and an address with a host.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b.*?(?:</(?:script|style)\b|\z)"
LINK = r"""(?i)<(?:a|area)\s(?:[^<>]*?\s)?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\s]+)"""

#: Verdict, and host and path that it holds for.
Rule = tuple[str, str]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, w)``: links between different hosts, counted; from rows ``(host, html)``."""
    seen = F.when(F.col("html").contains("//"), F.regexp_replace("html", UNSEEN, " "))
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(seen, F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def _per_source(links: DataFrame) -> DataFrame:
    """``(src, dst, share)``: what part of a host's links leads where."""
    totals = links.groupBy("src").agg(F.sum("w").alias("total"))
    return cut(links.join(totals, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))


def page_ranks(hosts: DataFrame, shares: DataFrame, seed: str, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``(host, mass, whole)`` after some rounds of PageRank from the seeds, and from all hosts alike.

    In each round a host keeps ``1 - damping`` of its seed, and what it held goes
    damped to the hosts it links to, or stays if it links to none.
    """
    gives = shares.select(F.col("src").alias("host")).distinct().withColumn("gives", F.lit(True))
    every = cut(hosts.join(gives, "host", "left").select("host", F.col(seed).alias("seed"), F.coalesce("gives", F.lit(False)).alias("gives")))
    now = every.select("host", F.col("seed").alias("mass"), F.lit(1.0).alias("whole"))
    for i in range(1, rounds + 1):
        moved = now.join(shares, now["host"] == shares["src"]).groupBy(F.col("dst").alias("host")).agg(*[F.sum(F.col(c) * F.col("share")).alias(f"in_{c}") for c in ("mass", "whole")])
        new = [((1 - damping) * start + damping * (F.when(F.col("gives"), 0.0).otherwise(F.col(c)) + F.coalesce(f"in_{c}", F.lit(0.0)))).alias(c) for c, start in (("mass", F.col("seed")), ("whole", F.lit(1.0)))]
        now = every.join(now, "host").join(moved, "host", "left").select("host", *new)
        if i % CUT_EVERY == 0:
            now = cut(now)
    return now


def led_to(hosts: DataFrame, shares: DataFrame, seed: str, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``(host, value)``: a host's own seed, and of the rest the damped mean of the hosts that its links lead to."""
    every = hosts.select("host", F.col(seed).alias("seed"))
    now = every.select("host", F.col("seed").alias("value"))
    for i in range(1, rounds + 1):
        met = shares.join(now.where("value > 0").withColumnRenamed("host", "dst"), "dst").groupBy(F.col("src").alias("host")).agg(F.sum(F.col("value") * F.col("share")).alias("met"))
        now = every.join(met, "host", "left").select("host", (F.col("seed") + (1 - F.col("seed")) * damping * F.coalesce("met", F.lit(0.0))).alias("value"))
        if i % CUT_EVERY == 0:
            now = cut(now)
    return now


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``(id, host, path, rule, verdict, trust, distrust)`` of every page."""
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).cast("string").alias("html"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = parts.select("id", "host", "path", name.alias("rule"), verdict.alias("own"))
    links = cut(host_links(parts))
    share = lambda kind: F.avg(F.when(F.col("own") == kind, 1.0).otherwise(0.0))
    hosts = judged.groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    if links.isEmpty():
        scores = hosts.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    else:
        ends = links.select(F.col("src").alias("host")).unionByName(links.select(F.col("dst").alias("host"))).distinct()
        none = F.lit(0.0)
        hosts = cut(hosts.join(ends, "host", "full_outer").select("host", F.coalesce("good", none).alias("good"), F.coalesce("bad", none).alias("bad")))
        shares = _per_source(links)
        trust = page_ranks(hosts, shares, "good", damping, rounds).select("host", F.try_divide("mass", "whole").alias("trust"))
        scores = trust.join(led_to(hosts, shares, "bad", damping, rounds).withColumnRenamed("value", "distrust"), "host")
    by_host = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return judged.join(scores, "host").select("id", "host", "path", "rule", F.coalesce("own", by_host).alias("verdict"), "trust", "distrust")
