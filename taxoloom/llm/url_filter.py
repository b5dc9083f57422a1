"""URL verdicts from rules, and from trust that spreads over the links between hosts.

Pages that a rule allows make their hosts trusted seeds, pages that a rule blocks distrusted ones, each by
the share of the host's pages. Trust follows links from a host to the hosts that it links to, distrust goes back from a host
to those that link to it, both as personalised PageRank over weighted host edges. A seed's weight does not
depend on how many seeds there are, so hosts without a path between them do not touch each other's
verdicts. A page without a rule gets its host's verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.scratch import settle
from .common import prepare

#: Fixed rules: verdict, host, start of the path.
RULES = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)
#: Share of a host's rank that it passes on; a host is blocked from this share of distrust in its rank.
DAMPING, BLOCKED_FROM = 0.85, 0.5
#: The loop ends when no host's rank moves by more than this share of it.
TOLERANCE = 1e-4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ADDRESS = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = "(?is)<a\\s[^>]*?\\bhref\\s*=\\s*[\"']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\\s>]+)"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the path, in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _ADDRESS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def _rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as ``verdict`` and ``rule``; of equally long ones the first by name."""
    best = None
    for verdict, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))
        best = F.when(fits, found) if best is None else best.when(fits, found)
    return best if best is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: number of pages of a host that link to another host."""
    linked = pages.select(
        host_of(F.col("url")).alias("src"),
        F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lambda u: host_of(F.concat(F.lit(":"), u))))).alias("dst"),
    )
    return linked.filter("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``kind, host, rank`` of every host that trust (kind 0) or distrust (kind 1) reaches.

    ``seeds`` has ``kind, host, weight``; the weight is where a seed's rank starts. What a host without edges would pass on is lost. A round
    is a join and a sum, written to the shared folder; rounds end when every host's rank settles
    relative to itself, so a host that is newly reached asks for another round, and the number of
    seeds does not matter.
    """
    both = edges.select(F.lit(0).alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    total = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    arcs = settle(both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "arcs")
    start = settle(seeds.select("kind", "host", F.col("weight").alias("rank")), "seeds")
    ranks = start
    while True:
        moved = ranks.join(arcs, (ranks["host"] == arcs["src"]) & (ranks["kind"] == arcs["kind"])).select(
            arcs["kind"], F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"), F.lit(0.0).alias("old")
        )
        base = start.select("kind", "host", (F.col("rank") * (1 - damping)).alias("rank"), F.lit(0.0).alias("old"))
        last = ranks.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("old"))
        after = settle(
            moved.unionByName(base).unionByName(last).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")),
            "ranks",
        )
        change = after.agg(F.max(F.when(F.col("rank") > 0, F.abs(F.col("rank") - F.col("old")) / F.col("rank")))).first()[0] or 0.0
        ranks = after.select("kind", "host", "rank")
        if change < tolerance:
            return ranks


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    ``rules`` are part of the plan, so they are a list that a person keeps; the longest one that
    fits decides. Otherwise a host is blocked if distrust is at least half of its rank (a tie blocks), and allowed if
    neither kind reaches it. Pages without a rule on a host that has pages with one count for it like trust, so
    a rule for some paths is not the verdict of the whole host unless links or most pages say so.

    A null url, and one without ``://``, has an empty host and path and is allowed. Null html has
    no links. Rows that repeat a page are judged each and count as pages of their host; without
    seeds or links all pages without a rule are allowed. An empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    named = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumn("found", _rule(F.col("host"), F.col("path"), rules))
    verdict = F.col("found.verdict")
    hosts = settle(
        named.groupBy("host").agg(
            F.avg(F.coalesce((verdict == "allow").cast("double"), F.lit(0.0))).alias("good"),
            F.avg(F.coalesce((verdict == "block").cast("double"), F.lit(0.0))).alias("bad"),
        ).filter("good > 0 OR bad > 0"),
        "hosts",
    )
    kinds = F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("good").alias("weight")), F.struct(F.lit(1).alias("kind"), F.col("bad").alias("weight"))))
    seeds = hosts.select("host", kinds).filter("weight > 0")
    ranks = spread(host_edges(pages.select("url", "html")), seeds)
    plain = hosts.select(F.lit(-1).alias("kind"), "host", ((1.0 - F.col("good") - F.col("bad")) * (1 - DAMPING)).alias("rank"))
    distrust = F.sum(F.when(F.col("kind") == 1, F.col("rank")).otherwise(0.0))
    blocked = (
        ranks.unionByName(plain).groupBy("host").agg(distrust.alias("bad"), F.sum("rank").alias("all"))
        .filter((F.col("bad") > 0) & (F.col("bad") >= F.col("all") * BLOCKED_FROM))
        .select(F.col("host").alias("bad_host"))
    )
    return named.join(blocked, (F.col("host") == F.col("bad_host")) & F.col("found").isNull(), "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )
