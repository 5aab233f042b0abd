"""URL filters that rules and the link graph decide together.

Each URL is judged by the longest rule that fits its host and path. URLs that no rule fits get their host's verdict:
personalised PageRank spreads trust from hosts with allowed pages along links, and distrust from hosts with blocked
pages against them (who links to a blocked host is suspect); a host is blocked where distrust exceeds trust. The walk goes on
until it has converged, however long the chains of links are.

Contract. A url that is null or has no :// has an empty host and path, is fitted by no rule and allowed; the empty
host takes part in no link. Null html has no links. Links inside a host are no edges; several links between two hosts
are one edge. A host with neither trust nor distrust is allowed, as is a tie. Mass of hosts without
links leaves the graph. Html of any length is read whole. Repeated rows are judged alike; they weigh in their host's seed as often as they stand there. An
empty table gives no rows. Extra columns of the input are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import lower_ascii, stored

#: The rules of the query.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DAMPING = 0.85
#: Links of a walk between two written tables.
STEPS = 4
#: Largest change of all mass at which verdicts are looked at; it goes on where one could still change.
TOLERANCE = 1e-6
#: Share of all mass that is below the precision of its sums.
REST = 1e-14
LINK = r"""(?i)\shref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits."""
    rule = verdict = None
    for action, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, slash, below = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + below)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict by rule alone, and html."""
    host, path = host_and_path(F.col("url").cast("string"))
    parts = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "html")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst: the distinct links between different hosts."""
    links = F.array_distinct(F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK), F.lit(1)))
    to = lower_ascii(F.regexp_extract("link", "//(.*)$", 1))
    return pages.select(F.col("host").alias("src"), F.explode(links).alias("link")).select("src", to.alias("dst")).where("src <> dst and src <> '' and dst <> ''").distinct()


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """host, kind, mass: personalised PageRank of kind t (along edges) and d (against them).

    seeds: host, kind, seed. The mass is written after each round of so many links, so no lineage grows and a lost
    executor costs a round's tasks. Rounds go on until they have reached every host that links lead to, and what is still
    to come over all hosts together can change no verdict, or is less than REST of all mass.
    """
    both = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit("t").alias("kind")).unionByName(edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit("d").alias("kind")))
    out = both.groupBy("host", "kind").agg(F.count(F.lit(1)).alias("links"))
    graph = stored(both.join(out, ["host", "kind"]), "url-graph")
    seeds = stored(seeds.select("host", "kind", "seed"), "url-seeds")
    kept = seeds.select("host", "kind", (F.col("seed") * (1 - damping)).alias("mass"))
    mass = kept
    while True:
        before = mass
        for _ in range(steps):
            moved = graph.join(mass, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("mass") / F.col("links") * damping).alias("mass"))
            mass = moved.unionByName(kept).groupBy("host", "kind").agg(F.sum("mass").alias("mass"))
        mass = stored(mass, "url-mass")
        change = mass.join(before.withColumnRenamed("mass", "was"), ["host", "kind"], "left").select("mass", "was", F.abs(F.col("mass") - F.coalesce("was", F.lit(0.0))).alias("change"))
        if _converged(mass, change, damping**steps):
            return mass


def _converged(mass: DataFrame, change: DataFrame, factor: float) -> bool:
    """Whether a round reached no new host, and all later rounds together change too little to matter.

    A round moves at most factor times what the one before it moved, so the later ones move the sum of a geometric series.
    """
    x = change.agg(F.sum("change").alias("change"), F.sum("mass").alias("mass"), F.count(F.when(F.col("was").isNull(), 1)).alias("new")).first()
    if x["new"]:
        return False
    rest, least = (x["change"] or 0.0) * factor / (1 - factor), REST * (x["mass"] or 0.0)
    if rest <= least:
        return True
    if rest > TOLERANCE:
        return False
    # hosts of one kind only are certain once they are reached; of the others the gap must exceed what is to come
    gap = F.abs(F.sum(F.when(F.col("kind") == "t", F.col("mass")).otherwise(-F.col("mass"))))
    return mass.groupBy("host").agg(gap.alias("gap"), F.count(F.lit(1)).alias("kinds")).where((F.col("kinds") > 1) & (F.col("gap") <= rest)).isEmpty()


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each page."""
    known = judged(pages, rules)
    counts = known.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("verdict") == "allow", 1)).alias("good"), F.count(F.when(F.col("verdict") == "block", 1)).alias("bad"))
    seeds = counts.select("host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), (F.col("good") / F.col("n")).alias("seed")), F.struct(F.lit("d").alias("kind"), (F.col("bad") / F.col("n")).alias("seed")))).alias("x")).select("host", "x.*").where("seed > 0")
    mass = propagated(seeds, host_edges(known))
    hosts = stored(mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "t", F.col("mass"))).alias("trust"), F.sum(F.when(F.col("kind") == "d", F.col("mass"))).alias("distrust")), "url-hosts")
    nothing = F.lit(0.0)
    own = F.when(F.coalesce("distrust", nothing) > F.coalesce("trust", nothing), "block").otherwise("allow")
    return known.drop("html").join(hosts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), F.coalesce("trust", nothing).alias("trust"), F.coalesce("distrust", nothing).alias("distrust"))
