"""URL filters by rules and by propagation over the host graph.

Hosts are nodes. A page's absolute links and its host's place in the domain tree (a host and the nearest host
above it that has pages) are edges. Hosts on an allow rule seed trust, which flows along edges as a
personalised PageRank; hosts on a block rule seed distrust, which flows against them. Both walk in one table.

A walk is pushed: a host keeps its share of the mass that reaches it and passes on the rest in equal parts, until no
host has more than ``least`` parts to pass on: a millionth of what one host has to give. So mass reaches hosts at any
distance, and what is still on its way at the end is below that at every host. Masses are whole numbers: all hosts
together have 10**15 parts to give, so sums neither overflow nor depend on the order in which Spark adds. What a host
without an edge to follow would pass on goes nowhere. A host that no rule decides is blocked when its distrust exceeds
its trust by more than ``margin``. All of it is DataFrame operations: links and paths never leave the JVM, pages are
reduced to distinct edges per host by partial aggregation, and every round exchanges host rows only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Workspace, written

#: Parts of rank that all hosts share, and the part of a host's share below which nothing is passed on.
UNIT, LEAST = 10**15, 10**6
#: Rounds between two written tables.
ROUNDS = 4


@dataclass(frozen=True)
class Rule:
    """A host suffix and the start of a path; ``text`` names it in results."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as struct(text, verdict), or null; equal lengths go by text."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, hosts: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (src, dst) between hosts of ``hosts``: from links in the pages and from the domain tree."""
    links = pages.select(
        host_of(F.col(url_col)).alias("src"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>/?#]+)"""), 1))).alias("to"),
    )
    links = links.select("src", F.translate(F.regexp_extract("to", "//(.*)$", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("dst")).distinct()
    links = links.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    up = hosts.filter(F.size(parts) >= 2).select("host", F.posexplode(above).alias("level", "upper"))
    up = up.join(hosts.select(F.col("host").alias("upper")), "upper", "left_semi")
    up = up.groupBy("host").agg(F.min_by("upper", "level").alias("upper"))
    tree = up.select(F.col("host").alias("src"), F.col("upper").alias("dst"))
    both = links.select("src", "dst").unionByName(tree).unionByName(tree.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.filter((F.col("src") != F.col("dst")) & (F.col("src") != "")).distinct()


def spread(edges: DataFrame, seeds: DataFrame, damping_percent: int, least: int) -> DataFrame:
    """(walk, host, mass): personalised PageRank along ``edges`` (walk, src, dst) from ``seeds`` (walk, host, seed)."""
    degree = edges.groupBy(F.col("walk").alias("d_walk"), F.col("src").alias("d_src")).agg(F.count(F.lit(1)).alias("degree"))
    out_edges = edges.join(degree, (F.col("walk") == F.col("d_walk")) & (F.col("src") == F.col("d_src")))
    out_edges = written(out_edges.select(F.col("walk").alias("e_walk"), "src", "dst", "degree"), "link-degrees")
    kept = F.expr(f"(moving * {100 - damping_percent}) div 100")
    # moving: what reached a host in the last round; mass: what it has kept so far.
    rank = seeds.select("walk", "host", F.col("seed").alias("moving"), F.lit(0).cast("long").alias("mass"))
    while True:
        for _ in range(ROUNDS):
            flow = rank.filter(F.col("moving") > least).join(out_edges, (F.col("walk") == F.col("e_walk")) & (F.col("host") == F.col("src")))
            flow = flow.select("walk", F.col("dst").alias("host"), F.expr(f"(moving * {damping_percent}) div (100 * degree)").alias("moving"), F.lit(0).cast("long").alias("mass"))
            stay = rank.select("walk", "host", F.lit(0).cast("long").alias("moving"), (F.col("mass") + kept).alias("mass"))
            rank = flow.unionByName(stay).groupBy("walk", "host").agg(F.sum("moving").alias("moving"), F.sum("mass").alias("mass"))
        rank = written(rank, "link-rank")
        if rank.filter(F.col("moving") > least).isEmpty():
            return rank.select("walk", "host", (F.col("mass") + kept).alias("mass")).filter("mass > 0")


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: tuple[Rule, ...] = RULES,
    damping_percent: int = 85,
    margin: int = 0,
) -> DataFrame:
    """A verdict per page: ``id_col``, host, path, rule, verdict, trust, distrust.

    Trust seeds are hosts in proportion to their pages under allow rules, distrust seeds to pages under block rules.
    Equal trust and distrust, none of either too, allow. Null urls and urls without :// have an empty host, which is no
    node, and are allowed. Null html has no links. Urls and html of any length are read whole. Repeated rows are judged
    one by one. An empty table gives an empty result. Other columns are not read.
    """
    slim = pages.select(F.col(id_col), F.col(url_col).alias("_url"))
    slim = slim.select(id_col, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    slim = slim.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    with Workspace() as w:
        per_host = slim.groupBy("host").agg(
            F.count_if(F.col("_rule.verdict") == "allow").alias("allowed"), F.count_if(F.col("_rule.verdict") == "block").alias("blocked"), F.count(F.lit(1)).alias("n")
        )
        hosts = written(per_host.filter(F.col("host") != ""), "link-hosts")
        share = UNIT // max(1, hosts.count())
        given = lambda part: F.expr(f"({share} div n) * {part} + (({share} % n) * {part}) div n")  # noqa: E731  share * part / n, rounded down
        forth = written(host_edges(pages.select(url_col, html_col), hosts, url_col, html_col), "link-edges")
        edges = forth.select(F.lit("trust").alias("walk"), "src", "dst")
        edges = edges.unionByName(forth.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst")))
        seeds = [hosts.filter(f"{part} > 0").select(F.lit(walk).alias("walk"), "host", given(part).alias("seed")) for walk, part in (("trust", "allowed"), ("distrust", "blocked"))]
        ranks = spread(edges, seeds[0].unionByName(seeds[1]), damping_percent, max(1, share // LEAST))
        of = lambda walk: F.sum(F.when(F.col("walk") == walk, F.col("mass")).otherwise(0)).alias(walk)
        scores = w.keep(written(ranks.groupBy(F.col("host").alias("s_host")).agg(of("trust"), of("distrust")), "link-scores"))
    judged = slim.join(scores, F.col("host") == F.col("s_host"), "left")
    zero = F.lit(0)
    trust_c, distrust_c = F.coalesce("trust", zero), F.coalesce("distrust", zero)
    by_graph = F.when(distrust_c - trust_c > margin, "block").otherwise("allow")
    return judged.select(
        id_col, "host", "path", F.col("_rule.text").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_graph).alias("verdict"), trust_c.alias("trust"), distrust_c.alias("distrust"),
    )
