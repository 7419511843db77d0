"""URL filters: rules by host and path, and link-graph propagation for hosts that no rule judges.

Rules: the longest rule whose host is the url's host or a parent domain of it, and whose path starts the url's path,
decides. Method: hosts that a page links to make weighted host edges (absolute, protocol-relative and relative links;
the page's own host is the source). Personalised PageRank spreads trust from the hosts of pages that an allow rule
judged, along links; distrust spreads from the hosts of blocked pages against the links, so hosts that link to
blocked ones are distrusted. A host seeds the share of its judged pages that were allowed or blocked, so its number of
pages has no weight. Ranks are in units of one wholly judged host: they aren't divided by the number of seeds or hosts,
so hosts that no link joins with a host don't move its verdict, and trust and distrust compare whatever the number of
their seeds. A host is blocked if its distrust is over ``threshold`` times its trust (equal: allowed) and ``floor`` (0.01) of a
judged host or more. A page without a rule gets its host's verdict.

At scale: links are counted per pair of hosts before anything is joined, so a host with a third of all pages is one
node; a round is one join of ranks with edges and one pre-aggregated sum, written to the shared folder. Edges are
never collected.

Defined cases: null urls and urls without ``://`` have empty host and path and, as any host without links and
seeds, verdict allow; null html has no links; html of any length is searched whole, in linear time; rules of equal
length that fit a url are taken in their order; repeated rows are judged each and count once more as links; an empty
table gives an empty table; extra columns don't reach the result and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import discard, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return host, path


def judge(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. The rules are few: one expression."""
    fits = [(r, ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)) for r in sorted(rules, key=lambda r: -len(r.text))]
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, fit in reversed(fits):
        rule, verdict = F.when(fit, F.lit(r.text)).otherwise(rule), F.when(fit, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(a, b, weight): links from pages of host a to host b; (host, url, html) in, self-links out."""
    links = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)<a\s[^<>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    target = F.translate(F.regexp_extract("link", r"//([^/?#]*)", 1), UPPER, LOWER)
    found = pages.select(F.col("host").alias("a"), F.explode(links).alias("link")).select("a", target.alias("b"))
    return found.where("a <> b and a <> '' and b <> ''").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def spread(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, rounds: int = 20, damping: float = 0.85, name: str = "rank") -> DataFrame:
    """Personalised PageRank (host, rank) over edges (a, b, weight) from seeds (host, weight); without seeds all ranks are 0.

    Ranks sum to the seeds' weights. What nodes without outgoing edges hold goes back to the seeds.
    """
    total = seeds.agg(F.sum("weight")).first()[0] or 0.0
    start = saved(nodes.join(seeds, "host", "left").select("host", F.coalesce("weight", F.lit(0.0)).alias("seed")), f"{name}-seeds")
    outgoing = edges.groupBy("a").agg(F.sum("weight").alias("total"))
    shares = saved(edges.join(outgoing, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("share")), f"{name}-shares")
    ranks = start.select("host", F.col("seed").alias("rank"))
    if not total or shares.isEmpty():
        return ranks
    before = None
    for _ in range(rounds):
        moved = shares.join(ranks.withColumnRenamed("host", "a"), "a").groupBy(F.col("b").alias("host")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        held = saved(moved, f"{name}-moved")
        kept = held.agg(F.sum("got")).first()[0] or 0.0
        rank = F.lit(damping) * F.coalesce("got", F.lit(0.0)) + F.col("seed") * F.lit(1 - damping * kept / total)
        ranks = saved(start.join(held, "host", "left").select("host", rank.alias("rank")), f"{name}-ranks")
        discard(held)
        if before is not None:
            discard(before)
        before = ranks
    return ranks


def host_verdicts(pages: DataFrame, threshold: float = 1.0, rounds: int = 20, floor: float = 0.01) -> DataFrame:
    """(host, trust, distrust, host_verdict) from pages (host, html, verdict of a rule or null)."""
    edges = saved(host_edges(pages), "url-edges")
    seen = saved(pages.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").cast("double").alias("allowed"), F.count_if(F.col("verdict") == "block").cast("double").alias("blocked")), "url-hosts")
    nodes = seen.select("host").union(edges.select("a")).union(edges.select("b")).distinct()
    nodes = saved(nodes, "url-nodes")
    judged = F.col("allowed") + F.col("blocked")
    trust = spread(edges, nodes, seen.where("allowed > 0").select("host", (F.col("allowed") / judged).alias("weight")), rounds, name="trust")
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")
    distrust = spread(turned, nodes, seen.where("blocked > 0").select("host", (F.col("blocked") / judged).alias("weight")), rounds, name="distrust")
    both = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host")
    bad = (F.col("distrust") > F.lit(threshold) * F.col("trust")) & (F.col("distrust") >= F.lit(floor))
    return both.withColumn("host_verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, threshold: float = 1.0, rounds: int = 20, floor: float = 0.01, id_column: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every row of (id, url, html)."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"), "html")
    rule, verdict = judge(F.col("host"), F.col("path"), RULES if rules is None else rules)
    judged = parsed.select("id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "html")
    hosts = saved(host_verdicts(judged, threshold, rounds, floor), "url-verdicts")
    rows = judged.drop("html").join(hosts, "host", "left")
    return rows.select(F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("verdict", "host_verdict", F.lit("allow")).alias("verdict"), "trust", "distrust")
