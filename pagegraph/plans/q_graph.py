"""Queries over link graphs: traversal, redirects, generators, coverage, retry and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.functions import policy
from pagegraph.operators import traverse
from pagegraph.registry import Registry, table

R = Registry()

#: A ten-way tree over page ids with some links across it.
EDGES = "g AS (SELECT (page_id - 1) // 10 AS src, page_id AS dst, CAST((page_id - 1) % 10 AS INTEGER) AS ord FROM pages WHERE page_id > 0 UNION ALL SELECT page_id AS src, (page_id * 7) % 50 AS dst, 10 AS ord FROM pages)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id")
    tree = p.where("page_id > 0").select(F.floor((F.col("page_id") - 1) / 10).alias("src"), F.col("page_id").alias("dst"), ((F.col("page_id") - 1) % 10).cast("int").alias("ord"))
    return tree.union(p.select(F.col("page_id"), (F.col("page_id") * 7) % 50, F.lit(10)))


def seed(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("url"))


WALK = f"WITH RECURSIVE {EDGES}, r AS (SELECT 0::BIGINT AS url, 0 AS depth UNION SELECT g.dst, r.depth + 1 FROM r JOIN g ON g.src = r.url WHERE r.depth < 4), m AS (SELECT url, min(depth) AS depth FROM r GROUP BY url)"


@R.add("crawl_bfs", f"{WALK} SELECT url, depth FROM m")
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.levels(seed(spark), edges(spark, sf_dir), 4).select("url", "depth")


@R.add(
    "bfs_order",
    f"WITH RECURSIVE {EDGES}, r AS (SELECT 0::BIGINT AS url, NULL::BIGINT AS parent, 0 AS depth, [0] AS way UNION ALL SELECT g.dst, r.url, r.depth + 1, list_append(r.way, g.ord) FROM r JOIN g ON g.src = r.url WHERE r.depth < 4) "
    "SELECT url, (arg_min(struct_pack(p := parent), (depth, way))).p AS parent, min(depth) AS depth FROM r GROUP BY url",
)
def bfs_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with the parent that comes first in the order of the frontier: by level, by the parents' order, by the place of the link."""
    return traverse.bfs(seed(spark), edges(spark, sf_dir), 4).select("url", "parent", "depth")


@R.add("depth_gate", f"{WALK} SELECT depth, count(*) AS pages FROM m WHERE depth < 2 GROUP BY depth")
def depth_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.levels(seed(spark), edges(spark, sf_dir), 4).where("depth < 2").groupBy("depth").agg(F.count("*").alias("pages"))


@R.add("page_budget", f"{WALK} SELECT least(count(*), 40) AS pages FROM m")
def page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.bfs(seed(spark), edges(spark, sf_dir), 4, max_pages=40).agg(F.count("*").alias("pages"))


@R.add("oracle_counts", f"{WALK} SELECT (SELECT count(*) FROM m) AS requests, (SELECT count(*) FROM g JOIN m ON m.url = g.src WHERE m.depth < 4) AS discovered, (SELECT count(*) FROM g JOIN m ON m.url = g.src WHERE m.depth < 4) - (SELECT count(*) - 1 FROM m) AS duplicates")
def oracle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = traverse.levels(seed(spark), edges(spark, sf_dir), 4)
    links = edges(spark, sf_dir).join(reached.where("depth < 4").select(F.col("url").alias("src")), "src").agg(F.count("*").alias("discovered"))
    pages = reached.agg(F.count("*").alias("requests"))
    return pages.withColumn("k", F.lit(1)).join(links.withColumn("k", F.lit(1)), "k").select("requests", "discovered", (F.col("discovered") - F.col("requests") + 1).alias("duplicates"))


@R.add("discoverable_paths", f"{WALK} SELECT concat('/', url) AS path FROM m WHERE url % 3 <> 0 OR url = 0")
def discoverable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.levels(seed(spark), edges(spark, sf_dir), 4).where("url % 3 <> 0 or url = 0").select(F.concat(F.lit("/"), F.col("url").cast("string")).alias("path"))


HOPS = "e AS (SELECT page_id AS src, CASE WHEN page_id % 8 = 7 AND page_id % 16 = 15 THEN page_id - 7 ELSE page_id + 1 END AS dst FROM pages WHERE page_id % 8 <> 7 OR page_id % 16 = 15)"


@R.add("redirect_chain", f"WITH RECURSIVE {HOPS}, r AS (SELECT src, dst AS final, 1 AS hops FROM e UNION ALL SELECT r.src, e.dst, hops + 1 FROM r JOIN e ON e.src = r.final WHERE hops < 21) SELECT r.src, final, hops, hops = 21 AS looped FROM r LEFT JOIN e ON e.src = r.final WHERE e.src IS NULL OR hops = 21")
def redirect_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to seven hops, half of them closed to loops."""
    p = F.col("page_id")
    hops = table(spark, sf_dir, "pages").where((p % 8 != 7) | (p % 16 == 15)).select(p.alias("src"), F.when((p % 8 == 7) & (p % 16 == 15), p - 7).otherwise(p + 1).alias("dst"))
    return traverse.redirect_chains(hops)


@R.add("gen_chain", "SELECT concat('/c', i) AS src, CASE WHEN i < 499 THEN concat('/c', i + 1) END AS dst, 0 AS ord FROM range(500) t(i)")
def gen_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.chain(spark, "/c", 500)


@R.add("gen_fanout", "SELECT '/' AS src, concat('/leaf', i) AS dst, i::INTEGER AS ord FROM range(1000) t(i)")
def gen_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.fanout(spark, "/", "/leaf", 1000)


@R.add("gen_tree", "SELECT (i - 1) // 10 AS src, i AS dst, ((i - 1) % 10)::INTEGER AS ord FROM range(1, 1111) t(i)")
def gen_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.tree(spark, 1111)


@R.add("gen_scale_counts", "SELECT n AS scale, least(n, 1000) AS unique_targets, greatest(1, n // 1000) AS hubs, n - n // 10 AS plain, n // 10 AS special FROM (SELECT unnest([100, 1000, 10000, 100000])::BIGINT AS n)")
def gen_scale_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = spark.range(4).select((100 * F.pow(F.lit(10.0), F.col("id"))).cast("bigint").alias("n"))
    return rows.select(n.alias("scale"), F.least(n, F.lit(1000).cast("bigint")).alias("unique_targets"), F.greatest(F.lit(1).cast("bigint"), F.floor(n / 1000)).alias("hubs"), (n - F.floor(n / 10)).alias("plain"), F.floor(n / 10).alias("special"))


@R.add("gen_scale_hubs", "SELECT concat('/hub', i // 100) AS src, concat('/hub', i // 100, '/leaf', i % 100) AS dst, (i % 100)::INTEGER AS ord FROM range(10000) t(i)")
def gen_scale_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site of hubs with a hundred leaves each."""
    i = F.col("id")
    hub = F.concat(F.lit("/hub"), F.floor(i / 100).cast("string"))
    return spark.range(10000).select(hub.alias("src"), F.concat(hub, F.lit("/leaf"), (i % 100).cast("string")).alias("dst"), (i % 100).cast("int").alias("ord"))


@R.add("dup_variants", "SELECT i, concat('https://s.example/t', i // 5, CASE i % 5 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '#f' WHEN 3 THEN '?' ELSE '/#x' END) AS url FROM range(300) t(i)")
def dup_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    end = F.when(i % 5 == 0, "").when(i % 5 == 1, "/").when(i % 5 == 2, "#f").when(i % 5 == 3, "?").otherwise("/#x")
    return spark.range(300).select(i.alias("i"), F.concat(F.lit("https://s.example/t"), F.floor(i / 5).cast("string"), end).alias("url"))


@R.add("site_edges", "SELECT page_id AS src, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, concat(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':', regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS label FROM pages")
def site_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels host:/path of links to other hosts."""
    from pagegraph.functions import scope, urls

    u = urls.split_url(F.col("url"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), scope.host_of(F.col("url")).alias("host"), F.concat(u.host, F.lit(":"), u.path).alias("label"))


COVER = "f AS (SELECT l_suppkey AS tool, concat('/p/', l_partkey) AS path FROM lineitem WHERE l_linenumber <= 4), t AS (SELECT l_suppkey AS tool, concat('/p/', l_partkey) AS path FROM lineitem WHERE l_linenumber >= 2), b AS (SELECT coalesce(x.tool, y.tool) AS tool, x.path AS f, y.path AS t FROM (SELECT DISTINCT * FROM f) x FULL JOIN (SELECT DISTINCT * FROM t) y ON x.tool = y.tool AND x.path = y.path)"


def cover(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tool"), F.concat(F.lit("/p/"), F.col("l_partkey").cast("string")).alias("path"), "l_linenumber")
    return rows.where("l_linenumber <= 4"), rows.where("l_linenumber >= 2")


@R.add("coverage_score", f"WITH {COVER} SELECT tool, count(*) FILTER (f IS NOT NULL AND t IS NOT NULL) AS hits, count(*) FILTER (t IS NULL) AS extra, count(*) FILTER (f IS NULL) AS missing, round(coalesce(100.0 * count(*) FILTER (f IS NOT NULL AND t IS NOT NULL) / nullif(count(*) FILTER (t IS NOT NULL), 0), 0), 6) AS recall FROM b GROUP BY tool")
def coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.coverage(*cover(spark, sf_dir), ["tool"])


@R.add("coverage_compare", f"WITH {COVER} SELECT tool % 4 AS kind, tool // 4 AS workload, count(*) FILTER (f IS NOT NULL AND t IS NOT NULL) AS hits, count(*) FILTER (f IS NULL) AS missing FROM b GROUP BY 1, 2")
def coverage_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = traverse.coverage(*cover(spark, sf_dir), ["tool"])
    return out.groupBy((F.col("tool") % 4).alias("kind"), F.floor(F.col("tool") / 4).alias("workload")).agg(F.sum("hits").alias("hits"), F.sum("missing").alias("missing"))


@R.add("coverage_paths", "SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) LIKE '%.example.com'")
def coverage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagegraph.functions import scope, urls

    rows = table(spark, sf_dir, "pages").where(scope.subdomain(F.col("url"), F.lit("example.com")))
    return rows.select(urls.split_url(F.col("url")).path.alias("path")).distinct()


@R.add("oracle_diff", "WITH a AS (SELECT l_orderkey % 100 AS w, count(*) AS requests, count(*) FILTER (l_returnflag = 'R') AS failed, count(DISTINCT l_partkey) AS uniq FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey % 100 AS w, count(*) AS requests, count(*) FILTER (l_linestatus = 'F') AS failed, count(DISTINCT l_suppkey) AS uniq FROM lineitem GROUP BY 1), u AS (SELECT a.w, unnest(['requests', 'failed', 'unique']) AS metric, unnest([a.requests, a.failed, a.uniq]) AS expected, unnest([b.requests, b.failed, b.uniq]) AS got FROM a JOIN b USING (w)) SELECT * FROM u WHERE expected <> got")
def oracle_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a summary that differ from the expected ones."""
    rows = table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_orderkey") % 100)
    one = rows.groupBy("w").agg(F.count("*").alias("requests"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.count_distinct("l_partkey").alias("unique"))
    two = rows.groupBy("w").agg(F.count("*").alias("requests"), F.count_if(F.col("l_linestatus") == "F").alias("failed"), F.count_distinct("l_suppkey").alias("unique"))
    names = ["requests", "failed", "unique"]
    j = one.unpivot("w", names, "metric", "expected").join(two.unpivot("w", names, "metric", "got"), ["w", "metric"])
    return j.where("expected <> got").select("w", "metric", "expected", "got")


TRIES = "SELECT l_orderkey AS k, l_linenumber AS attempt, l_partkey AS p, CASE l_suppkey % 6 WHEN 0 THEN 500 WHEN 1 THEN 429 WHEN 2 THEN 404 WHEN 3 THEN 503 WHEN 4 THEN 200 ELSE 501 END AS status, CASE WHEN l_partkey % 11 = 0 THEN 'timeout' WHEN l_partkey % 11 = 1 THEN 'too many redirects' END AS error, CASE l_partkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '0.5' WHEN 2 THEN 'Wed, 21 Oct 2015 07:28:00 GMT' ELSE '90' END AS header FROM lineitem"
AFTER = "coalesce(CASE WHEN regexp_matches(header, '^[0-9]+([.][0-9]+)?$') THEN round(try_cast(header AS DOUBLE) * 1000)::BIGINT END, 0)"


def tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(TRIES)


@R.add("retry_after", f"SELECT k, attempt, p, header, {AFTER} AS wait_ms FROM ({TRIES})")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries(spark, sf_dir).select("k", "attempt", "p", "header", policy.retry_after_ms(F.col("header")).alias("wait_ms"))


@R.add("retry_decision", f"SELECT k, attempt, p, attempt < 3 AND ((error IS NOT NULL AND error <> 'too many redirects') OR (error IS NULL AND status IN (429, 500, 502, 503, 504))) AS retry, greatest(least(30000, (500 * pow(2, attempt))::BIGINT), {AFTER}) AS cap_ms FROM ({TRIES})")
def retry_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries(spark, sf_dir).select("k", "attempt", "p", policy.should_retry(F.col("attempt"), F.col("status"), F.col("error")).alias("retry"), policy.retry_delay_cap_ms(F.col("attempt"), F.col("header")).alias("cap_ms"))


@R.add("retry_legacy", f"SELECT k, attempt, p, attempt < 2 AND error IS NULL AND status = 429 AS retry, greatest(5000, {AFTER}) AS wait_ms FROM ({TRIES})")
def retry_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries(spark, sf_dir).select("k", "attempt", "p", policy.legacy_retry(F.col("attempt"), F.col("status"), F.col("error")).alias("retry"), policy.legacy_delay_ms(F.col("header")).alias("wait_ms"))


@R.add("retry_outcome", f"WITH t AS (SELECT k, attempt, p, coalesce(status, 0) AS status, attempt < 3 AND ((error IS NOT NULL AND error <> 'too many redirects') OR (error IS NULL AND status IN (429, 500, 502, 503, 504))) AS retry FROM ({TRIES})) SELECT k, min(attempt) FILTER (NOT retry) AS attempts FROM t GROUP BY k")
def retry_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attempt that is not retried."""
    rows = tries(spark, sf_dir).withColumn("retry", policy.should_retry(F.col("attempt"), F.col("status"), F.col("error")))
    return rows.groupBy("k").agg(F.min(F.when(~F.col("retry"), F.col("attempt"))).alias("attempts"))


@R.add("content_type_allowed", "SELECT p_partkey AS k, kind, regexp_matches(lower(kind), 'html|javascript|json|xml') AS allowed FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/JSON' WHEN 3 THEN 'image/svg+xml' WHEN 4 THEN '' ELSE 'text/plain' END AS kind FROM part)")
def content_type_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") % 6
    kind = F.when(s == 0, "Text/HTML; charset=utf-8").when(s == 1, "image/png").when(s == 2, "application/JSON").when(s == 3, "image/svg+xml").when(s == 4, "").otherwise("text/plain")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), kind.alias("kind")).withColumn("allowed", policy.content_allowed(F.col("kind")))


@R.add("body_cap", "SELECT page_id, least(strlen(html), 2000)::INTEGER AS bytes, strlen(html) > 2000 AS truncated, strlen(html) AS full_bytes FROM pages")
def body_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    body, over = policy.capped(F.encode("html", "utf-8"), 2000)
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length(body).alias("bytes"), over.alias("truncated"), F.octet_length("html").cast("long").alias("full_bytes"))


@R.add("status_split", f"SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN status >= 400 THEN 'failed' ELSE 'ok' END AS outcome, count(*) AS n FROM ({TRIES}) GROUP BY 1")
def status_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("status") >= 400, "failed").otherwise("ok")
    return tries(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


QUERIES, ORACLES = R.queries, R.oracles
