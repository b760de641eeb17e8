"""URL filters by link-graph propagation: trust flows along links, distrust against them.

Explicit host and path rules judge first. Hosts of pages that an allow rule fits seed a
personalised PageRank over host edges; hosts of pages that a block rule fits seed one over
the reversed edges. A host whose distrust exceeds its trust is blocked. DataFrame
operations only.

Edges are host pairs with counts, so a host that a third of the pages share is one row
by source and target. Each iteration is one join and one aggregate with partial sums; they
go on until no host's score changes by more than TOLERANCE of itself, so a host at any
distance from a seed is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.llm._store import materialize, unused

#: The production rules (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
TOLERANCE = 1e-6
CHECK_EVERY = 4
THRESHOLD = 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null; of rules of equal length, the first given."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    for verdict, rule_host, rule_path in reversed(ranked):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between hosts (source, target, weight) from href attributes; links within a host don't count."""
    links = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    raw = pages.select(url_host(F.col("url")).alias("source"), F.explode(links).alias("link"))
    target = url_host(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    return raw.select("source", target.alias("target")).where("source != '' and target != '' and source != target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank (kind, host, score) over edges (kind, source, target, share) from seeds (kind, host, mass).

    share is the part of the source's score that goes to the target; mass sums to 1 by
    kind. What a host without links would pass on is lost, as in TrustRank. Every CHECK_EVERY
    iterations the scores are written and compared with those written before: the last ones
    where every host's relative change is within tolerance (a host just reached has 1).
    """
    if not 0 <= damping < 1:
        raise ValueError("scores converge only where damping is below 1")
    rank = seeds.select("kind", "host", F.col("mass").alias("score"))
    base = seeds.select("kind", "host", ((1 - damping) * F.col("mass")).alias("score"))
    done = 0
    while True:
        before = rank
        for k in range(CHECK_EVERY):
            moved = rank.withColumnRenamed("host", "source").join(edges, ["kind", "source"]).select("kind", F.col("target").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
            parts = base.unionByName(moved).withColumn("before", F.lit(0.0))
            if k == CHECK_EVERY - 1:
                parts = parts.unionByName(before.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("before")))
            rank = parts.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before"))
        done += CHECK_EVERY
        written = materialize(rank, f"rank_{done}", compact=True)
        rank = written.select("kind", "host", "score")
        if written.where(F.abs(F.col("score") - F.col("before")) > tolerance * F.col("score")).isEmpty():
            return rank


def host_scores(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """By host: trust and distrust."""
    judged = pages.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = judged.where("host != ''").select("host", matching_rule(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict"))
    counts = judged.groupBy("host").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("allow", "block")])
    counts = materialize(counts, "host_counts", compact=True)
    total = counts.agg(F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"))
    seeds = counts.crossJoin(F.broadcast(total))  # one row
    seeds = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("allow") / F.greatest("all_allow", F.lit(1))).alias("mass")), F.struct(F.lit("distrust").alias("kind"), (F.col("block") / F.greatest("all_block", F.lit(1))).alias("mass")))).alias("s")).select("host", "s.*").where("mass > 0")
    links = materialize(host_edges(pages), "host_edges")
    both = links.select(F.lit("trust").alias("kind"), "source", "target", "weight").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    out = both.groupBy("kind", "source").agg(F.sum("weight").alias("all_weight"))
    shares = both.join(out, ["kind", "source"]).select("kind", "source", "target", (F.col("weight") / F.col("all_weight")).alias("share"))
    rank = propagate(materialize(shares, "host_shares", compact=True), materialize(seeds, "host_seeds", compact=True), damping, tolerance)
    return rank.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])


def judge_urls(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """The pages with host, path, rule, verdict, trust and distrust (columns of these names are replaced).

    A rule's verdict wins; without one, a host is blocked where distrust > threshold * trust.
    Hosts that no seed reaches, and urls that are null or have no ://, are allowed. The url
    and html columns may be null.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "trust", "distrust")]
    host = url_host(F.col("url"))
    path = url_path(F.col("url"))
    rule_name, host_name = unused(names, "_rule", "_host")
    rows = pages.select(*names).withColumns({"host": host, "path": path}).withColumn(rule_name, matching_rule(F.col("host"), F.col("path"), rules))
    scores = materialize(host_scores(pages, rules, damping, tolerance), "host_scores").withColumnRenamed("host", host_name)
    joined = rows.join(scores, F.col("host") == F.col(host_name), "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    found = F.when(distrust > threshold * trust, "block").otherwise("allow")
    return joined.select(*names, "host", "path", F.col(rule_name)["rule"].alias("rule"), F.coalesce(F.col(rule_name)["verdict"], found).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
