"""URL filters: rules by host and path, and for the rest a verdict per host
from the link graph. Spark SQL expressions and joins only.

A host's seed is the share of its pages that rules allow (trust) and that
rules block (distrust). Over the host graph (an edge weighs the share of the
linking host's pages with links to other hosts, dealt over their targets)

* trust is a personalised PageRank from the trusted seeds: a host has its
  seed and, damped, its part of the trust of each host that links to it (so
  a seed's own rank is its share, not divided by the number of seeds);
* distrust runs against the links from the blocked seeds: it is the chance
  that a walk from the host, damped at each link, ends on a blocked page.

Both take ROUNDS rounds. A host is blocked if its distrust is more than
MARGIN above its trust. So a host without links to others is judged by the
majority of its pages, and a host that trusted ones link to is let through.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import stored
from spendlens.operators.joins import broadcast_if_small

DAMPING, ROUNDS, MARGIN = 0.85, 20, 0.5
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)<(?:a|area)\s[^<>]*>"
BASE = r"(?i)<base\s[^<>]*>"
HREF = r"""(?i)\shref\s*=\s*["']?\s*([^"'\s>]*)"""
NOT_ENDORSED = r"""(?i)\srel\s*=\s*["']?[^"'>]*\b(?:nofollow|ugc|sponsored)\b"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def matching(rules: list[Rule], host: Column, path: Column, result: str) -> Column:
    """Of the longest rule that fits (block before allow), its text or its
    verdict, else null. For lists of some hundred rules: one expression."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, r.host + r.path if result == "rule" else r.verdict).otherwise(out)
    return out


def _target(tag: Column, base: Column) -> Column:
    """Host that a link's tag leads to; null for other schemes and without href."""
    href = F.regexp_extract(tag, HREF, 1)
    return (
        F.when(href.rlike("^(?i)https?://"), host_of(href))
        .when(href.startswith("//"), host_of(F.concat(F.lit("x:"), href)))
        .when(~href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & tag.rlike(HREF), base)
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts. ``n`` pages of src
    link to dst, each counted once; weights of a src sum to 1. Links marked
    nofollow, ugc or sponsored don't count. A tag ends at its first ``>``."""
    base = F.regexp_extract("html", BASE, 0)
    tags = F.filter(F.regexp_extract_all("html", F.lit(LINK), F.lit(0)), lambda t: ~t.rlike(NOT_ENDORSED))
    own = pages.select(host_of(F.col("url")).alias("src"), tags.alias("tags"), base.alias("base")).where((F.col("src") != "") & (F.size("tags") > 0))
    at = own.withColumn("at", F.coalesce(F.when(F.col("base") != "", _target(F.col("base"), F.col("src"))), F.col("src")))
    found = F.array_distinct(F.transform("tags", lambda t: _target(t, F.col("at"))))
    other = F.filter(found, lambda h: h.isNotNull() & (h != "") & (h != F.col("src")))
    n = at.select("src", F.explode(other).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    n = stored(n)
    total = n.groupBy("src").agg(F.sum("n").alias("total"))
    return n.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def seeds(pages: DataFrame, edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """(host, trusted, blocked) of every host of ``pages`` and ``edges``. A
    host without pages is taken to be its path ``/``."""
    at = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    verdict = matching(rules, F.col("host"), F.col("path"), "verdict")
    share = lambda v, col: F.avg((F.coalesce(col, F.lit("")) == v).cast("double"))
    own = at.groupBy("host").agg(share("allow", verdict).alias("trusted"), share("block", verdict).alias("blocked"))
    linked = edges.select(F.col("dst").alias("host")).distinct().join(own, "host", "left_anti")
    unseen = F.coalesce(matching(rules, F.col("host"), F.lit("/"), "verdict"), F.lit(""))
    return own.unionByName(linked.select("host", (unseen == "allow").cast("double").alias("trusted"), (unseen == "block").cast("double").alias("blocked")))


def host_scores(pages: DataFrame, rules: list[Rule], rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of every host. Each round's values are a
    table in the checkpoint folder; the edges are joined by shuffle, where
    Spark splits hosts with very many links."""
    edges = stored(host_edges(pages))
    known = stored(seeds(pages, edges, rules))
    now = known.select("host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust"))
    if edges.isEmpty():
        return now
    for _ in range(rounds):
        forward = edges.join(now.select(F.col("host").alias("src"), "trust"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("weight") * F.col("trust")).alias("gets"))
        backward = edges.join(now.select(F.col("host").alias("dst"), "distrust"), "dst").groupBy(F.col("src").alias("host")).agg(F.sum(F.col("weight") * F.col("distrust")).alias("leads"))
        trust = F.col("trusted") + DAMPING * F.coalesce("gets", F.lit(0.0))
        distrust = F.col("blocked") + (1 - F.col("blocked")) * DAMPING * F.coalesce("leads", F.lit(0.0))
        now = stored(known.join(forward, "host", "left").join(backward, "host", "left").select("host", trust.alias("trust"), distrust.alias("distrust")))
    return now


def judged_urls(pages: DataFrame, rules: list[Rule], rounds: int = ROUNDS) -> DataFrame:
    """``pages`` (url, html) with host, path, rule (or null) and verdict.

    A url that is null or holds no ``://`` has neither host nor path, fits
    no rule and is allowed. Null or empty html has no links. Repeated rows
    are judged each, and each counts as a page. An empty table gives no
    rows. Columns of ``pages`` with the names of the results are replaced."""
    own = pages.drop("host", "path", "rule", "verdict")
    bad = stored(host_scores(pages.select("url", "html"), rules, rounds).where(F.col("distrust") - F.col("trust") > MARGIN).select(F.col("host").alias("_bad")))
    at = own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    ruled = at.withColumn("rule", matching(rules, F.col("host"), F.col("path"), "rule")).withColumn("verdict", matching(rules, F.col("host"), F.col("path"), "verdict"))
    found = ruled.join(broadcast_if_small(bad), F.col("host") == F.col("_bad"), "left")
    method = F.when(F.col("_bad").isNotNull(), "block").otherwise("allow")
    return found.withColumn("verdict", F.coalesce("verdict", method)).drop("_bad")
