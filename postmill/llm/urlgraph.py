"""URL filter: host and path rules, and trust and distrust over the link graph for the rest. DataFrame functions only."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.session import shuffle_width, written

# Fixed values of the contract: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

DAMPING = 0.85
# Rounds go on until the three ranks, each of which sums to 1 over all hosts, change by less than this in sum.
TOLERANCE = 1e-3
# Rounds that are planned together; their result is written and its last change looked at.
TOGETHER = 3
# Rows of the graph that a task gets at least: a small graph is not dealt to more tasks than it keeps busy.
TASK_ROWS = 200_000
# Share of a host's pages that block (allow) rules must decide for the host to be a blocked (trusted) seed.
SEED_SHARE = 0.5
# A host is blocked if its share of distrust in trust and distrust is above this, and its distrust above its baseline.
SPAM_SHARE = 0.5
# Weight of the edges between a host and its parent domain, in links.
DOMAIN_LINKS = 1.0

LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>\\]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url)))


def _matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); a rule fits its host and all subdomains."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def split_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, said) per row: the rule that decides, and what it says."""
    url = pages["url"].cast("string")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.withColumn("hit", _matched(F.col("host"), F.col("path"), rules)) \
        .select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("said"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts: absolute links of the pages' html, counted before they are shuffled."""
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    links = pages.select(host_of(pages["url"].cast("string")).alias("src"),
                         F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("target"))
    ends = links.select("src", _lower(F.regexp_replace("target", "^.*@", "")).alias("dst"))
    return ends.filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst") \
        .agg(F.count("*").cast("double").alias("links"))


def _domain_edges(hosts: DataFrame, weight: float) -> DataFrame:
    """Both ways between each host and its parent domain of two labels or more, and so on upwards."""
    labels = F.split("host", r"\.")
    chains = hosts.filter(F.size(labels) > 2).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels) - 2),
        lambda k: F.struct(F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("low"),
                           F.array_join(F.slice(labels, k + 1, F.size(labels)), ".").alias("high")))).alias("e"))
    pairs = chains.select("e.low", "e.high").distinct()
    return pairs.select(F.col("low").alias("src"), F.col("high").alias("dst"), F.lit(weight).alias("links")).unionByName(
        pairs.select(F.col("high").alias("src"), F.col("low").alias("dst"), F.lit(weight).alias("links")))


def _weighted(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(start, end, weight): an edge's part of all that leaves ``start``."""
    total = edges.groupBy(start).agg(F.sum("links").alias("total"))
    return edges.join(total, start).select(F.col(start).alias("start"), F.col(end).alias("end"),
                                           (F.col("links") / F.col("total")).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust, base): personalised PageRank of trust along the edges and of distrust against them.

    ``base`` is what a host gets of distrust if all hosts are equal seeds.

    ``seeds`` is (host, trusted, blocked), masses that are normalised to 1 each. Hosts without a way on keep
    what they have. A round joins the ranks to the edges by host and sums by host; every few rounds are written to the
    shared folder, so that plans stay short and a lost executor costs few. Rounds end when the summed absolute change of all
    ranks in one of them is below ``tolerance``. Changes shrink by the damping each round, which bounds the rounds;
    ranks that have not settled by then are an error.
    """
    hosts = edges.select(F.explode(F.array("src", "dst")).alias("host")).union(seeds.select("host")).distinct()
    total = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    trusted, blocked = float(total["t"] or 0.0) or 1.0, float(total["b"] or 0.0) or 1.0
    hosts = written(hosts, "all-hosts")
    each = 1.0 / max(hosts.count(), 1)
    start = written(hosts.join(seeds, "host", "left").select(
        "host", F.lit(each).alias("s_base"), (F.coalesce("trusted", F.lit(0.0)) / trusted).alias("s_trust"),
        (F.coalesce("blocked", F.lit(0.0)) / blocked).alias("s_distrust")), "hosts")
    out, back = _weighted(edges, "src", "dst"), _weighted(edges, "dst", "src")
    kinds = [w.withColumn("kind", F.lit(kind)) for kind, w in (("trust", out), ("distrust", back))]
    # Self-loops where a host has no edge in a direction.
    loops = [hosts.join(w.select(F.col("start").alias("host")).distinct(), "host", "left_anti").select(
        F.col("host").alias("start"), F.col("host").alias("end"), F.lit(1.0).alias("weight"), F.lit(kind).alias("kind"))
        for kind, w in (("trust", out), ("distrust", back))]
    ways = written(kinds[0].unionByName(kinds[1]).unionByName(loops[0]).unionByName(loops[1]), "ways")
    tasks = max(1, min(shuffle_width(edges.sparkSession), math.ceil(ways.count() / TASK_ROWS)))
    ways, start = ways.coalesce(tasks), start.coalesce(tasks)
    names = ("trust", "distrust", "base")
    ranks = start.select("host", *(F.col(f"s_{k}").alias(k) for k in names))
    restart = start.select("host", *(((1 - damping) * F.col(f"s_{k}")).alias(k) for k in names))
    part = damping * F.col("weight")
    ahead = F.col("kind") == "trust"

    def one_round(ranks: DataFrame) -> DataFrame:
        moved = ways.join(ranks.select(F.col("host").alias("start"), *names), "start").select(
            F.col("end").alias("host"), F.when(ahead, F.col("trust") * part).alias("trust"),
            *(F.when(~ahead, F.col(k) * part).alias(k) for k in names[1:]))
        return moved.unionByName(restart).groupBy("host").agg(*(F.sum(k).alias(k) for k in names)).coalesce(tasks)

    # Two ranks that both sum to 1 differ by 2 at most; three of them change, and each round leaves ``damping`` of it.
    most = 1 + math.ceil(math.log(max(tolerance, 1e-300) / 6) / math.log(damping))
    for _ in range(-(-most // TOGETHER)):
        for _ in range(TOGETHER - 1):
            ranks = one_round(ranks)
        now = one_round(ranks).join(ranks.select("host", *(F.col(k).alias(f"b_{k}") for k in names)), "host")
        change = sum((F.abs(F.col(k) - F.col(f"b_{k}")) for k in names), F.lit(0.0))
        ranks = written(now.select("host", *names, change.alias("change")), "ranks")
        if (ranks.agg(F.sum("change")).first()[0] or 0.0) < tolerance:
            return ranks.drop("change")
    raise RuntimeError(f"ranks did not settle to {tolerance} in {most} rounds")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) per row of ``pages``.

    The longest rule that fits a url decides it. Otherwise its host does: hosts most of whose pages are allowed
    (blocked) by rules are trusted (blocked) seeds, trust goes along links and distrust against them, and a host whose
    part of distrust is above SPAM_SHARE is blocked if it also has more distrust than it would if all hosts were blocked
    alike, so that a domain's hub does not hand the verdict on one host to all others. Edges are the absolute links of the pages and those between a host
    and its parent domain. Hosts that neither reaches are allowed, and so are urls without a host (trust and
    distrust null). Null and malformed urls have empty host and path; repeated rows give repeated rows.
    """
    rules = RULES if rules is None else rules
    urls = split_urls(pages, rules)
    per_host = written(urls.filter("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("allowed"),
        F.count_if(F.col("said") == "block").alias("blocked")), "hosts")
    seeds = per_host.select(
        "host", F.when(F.col("allowed") > SEED_SHARE * F.col("n"), 1.0).otherwise(0.0).alias("trusted"),
        F.when(F.col("blocked") > SEED_SHARE * F.col("n"), 1.0).otherwise(0.0).alias("blocked"))
    edges = written(host_edges(pages).unionByName(_domain_edges(per_host.select("host"), DOMAIN_LINKS))
                    .groupBy("src", "dst").agg(F.sum("links").alias("links")), "links")
    ranks = propagate(edges, seeds, tolerance)
    spam = (F.col("distrust") > SPAM_SHARE * (F.col("trust") + F.col("distrust"))) & (F.col("distrust") > F.col("base"))
    verdict = F.when(F.col("said").isNotNull(), F.col("said")).when(spam, "block").otherwise("allow")
    return urls.join(ranks, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
