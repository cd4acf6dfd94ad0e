"""URL filters from built-in functions: rules by longest match, and trust and distrust over the host graph.

Pages whose rule allows or blocks them are the seeds. Trust follows links from trusted hosts;
distrust runs against them, from blocked hosts to those that link to them: personalised
PageRank with damping DAMPING over edges with their counts, until what is still to come is below
TOLERANCE for all hosts together. What a host's seeds give it
counts as the share of its pages. A host is blocked where distrust is THRESHOLD above trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagegraph.llm.common import attach, drop_table, table, written

DAMPING, THRESHOLD = 0.85, 0.5
#: Score that may be missing at the end, all hosts together. ROUNDS is of the SQL twin alone: what it leaves out is as small.
TOLERANCE, ROUNDS = 1e-6, 110
#: Rows of (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = "[Hh][Rr][Ee][Ff]\\s*=\\s*[\"']?(?:[Hh][Tt][Tt][Pp][Ss]?:)?//([^/?#\"'\\s<>]+)"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and by_rule: of the rules that fit host and path the longest; null if none."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        best = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return pages.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "by_rule": F.col("_best.verdict")}).drop("_best")


def spread(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(kind, host, score): personalised PageRank of seeds (kind, host, score) over edges (kind, src, dst, share), as a multiple of 1 - damping.

    The sum of what the seeds send over paths of 0, 1, 2, ... edges; sent is what arrives by the last.
    All that follows is at most damping / (1 - damping) times that.
    """
    edges = written(edges, "op7-edges")  # a host may have a third of all edges: they are dealt by its sub-keys

    def kept(rows: DataFrame) -> tuple[DataFrame, float]:
        left = Observation()
        out = written(rows.observe(left, F.sum("sent").alias("sent")), "op7-rank")
        return out, left.get["sent"] or 0.0

    now, left = kept(seeds.select("kind", "host", F.col("score").alias("sent"), "score"))
    while left * damping / (1 - damping) > tolerance:
        given = attach(edges, now.where("sent > 0").select("kind", F.col("host").alias("src"), "sent"), ["kind", "src"], ["dst"], "inner")
        given = given.select("kind", F.col("dst").alias("host"), (F.col("sent") * F.col("share") * damping).alias("sent"))
        both = given.select("*", F.col("sent").alias("score")).union(now.select("kind", "host", F.lit(0.0), "score"))
        nxt, left = kept(both.groupBy("kind", "host").agg(F.sum("sent").alias("sent"), F.sum("score").alias("score")))
        drop_table(now)
        now = nxt
    drop_table(edges)
    return now.select("kind", "host", F.round("score", 9).alias("score"))


def shares(links: DataFrame, kind: str, src: str, dst: str) -> DataFrame:
    out = links.groupBy(src).agg(F.sum("n").alias("all"))
    return attach(links, out, [src], [dst], "inner").select(F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("n") / F.col("all")).alias("share"))


def host_scores(pages: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of hosts with any, from pages (host, by_rule) and links (a, b, n)."""
    hosts = pages.groupBy("host").agg((F.count_if(F.col("by_rule") == "allow") / F.count("*")).alias("trust"), (F.count_if(F.col("by_rule") == "block") / F.count("*")).alias("distrust"))
    hosts = written(hosts.where("host <> ''"), "op7-hosts")
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in ("trust", "distrust")])
    seeds = hosts.select("host", F.inline(both)).where("score > 0").select("kind", "host", "score")
    if not links.isEmpty():
        seeds = spread(seeds, shares(links, "trust", "a", "b").union(shares(links, "distrust", "b", "a")), damping, tolerance)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return seeds.groupBy("host").agg(of("trust"), of("distrust"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, host, path, rule, verdict.

    Null url, or one without ://: host and path are empty and the verdict is allow, unless a rule fits. Null
    html: no links. Repeated rows count as pages of their own. Extra columns are not read.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    base = with_rule(base, rules)
    links = pages.select(host_of(F.col("url").cast("string")).alias("a"), F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK), F.lit(1))).alias("b"))
    links = links.select("a", F.translate("b", UPPER, LOWER).alias("b")).where("a <> '' and a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    scores = host_scores(base.select("host", "by_rule"), written(links, "op7-links"))
    blocked = scores.where(F.col("distrust") - F.col("trust") >= threshold).select("host", F.lit("block").alias("by_graph"))
    out = attach(base, blocked, ["host"], [F.coalesce("page_id", F.lit(0)), "path"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_graph", F.lit("allow")).alias("verdict"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def _sql() -> str:
    cases = " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))

    def rank(name: str, src: str, dst: str) -> str:
        edges = f"{name}_e AS (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS share FROM k)"
        walk = f"{name}_w AS (SELECT host, {name}::DOUBLE AS sent, 0 AS step FROM hs WHERE {name} > 0 UNION ALL SELECT e.dst, sum(w.sent * e.share * {DAMPING}), w.step + 1 FROM {name}_w w JOIN {name}_e e ON e.src = w.host WHERE w.step < {ROUNDS} GROUP BY e.dst, w.step)"
        return f"{edges}, {walk}, {name}_z AS (SELECT host, round(sum(sent), 9) AS score FROM {name}_w GROUP BY host)"

    alphabet = f"'{UPPER}', '{LOWER}'"
    host = f"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {alphabet})"
    link = LINK.replace("'", "''")
    return f"""
WITH RECURSIVE b AS (SELECT page_id, {host} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM pages),
c AS (SELECT *, CASE {cases} END AS r FROM b),
d AS (SELECT page_id, host, path, string_split(r, '|')[1] AS rule, string_split(r, '|')[2] AS by_rule FROM c),
l AS (SELECT host AS a, translate(unnest(regexp_extract_all(html, '{link}', 1)), {alphabet}) AS b FROM b),
k AS (SELECT a, b, count(*) AS n FROM l WHERE a <> '' AND a <> b GROUP BY a, b),
hs AS (SELECT host, count(*) FILTER (by_rule = 'allow') / count(*) AS trust, count(*) FILTER (by_rule = 'block') / count(*) AS distrust FROM d WHERE host <> '' GROUP BY host),
{rank("trust", "a", "b")}, {rank("distrust", "b", "a")},
s AS (SELECT host FROM (SELECT host, score AS t, 0.0 AS x FROM trust_z UNION ALL SELECT host, 0.0, score FROM distrust_z) GROUP BY host HAVING sum(x) - sum(t) >= {THRESHOLD})
SELECT page_id, d.host, path, rule, coalesce(by_rule, CASE WHEN s.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM d LEFT JOIN s ON s.host = d.host
"""


QUERIES = {"op7_urls": op7_urls}
ORACLES = {"op7_urls": _sql()}
