"""Queries over the small rules of a crawl: assembled scopes, errors, outputs, schedules, attribute and key lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.functions import policy, scope
from pagegraph.operators import extract, html, openapi, traverse
from pagegraph.operators.ranks import numbered
from pagegraph.plans import q_graph
from pagegraph.plans.q_extract import text
from pagegraph.plans.q_urls import HOST_SQL, VARIANT_SQL, variants
from pagegraph.registry import Registry, dealt, table

R = Registry()
HOST_PORT = "lower(regexp_extract({0}, '^([A-Za-z]+://[^/?#]*)', 1))"
SEED_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"


@R.add(
    "scope_assembled",
    f"WITH x AS ({VARIANT_SQL}), y AS (SELECT x.page_id, v, u, url FROM x JOIN pages USING (page_id)) SELECT page_id, v, {HOST_PORT.format('u')} = {HOST_PORT.format('url')} AND NOT regexp_matches(u, 'ref=') AS same_origin, "
    f"({HOST_SQL} = {SEED_HOST} OR suffix({HOST_SQL}, '.' || {SEED_HOST})) AND NOT ({HOST_SQL} = 'example.org' OR suffix({HOST_SQL}, '.example.org')) AS subdomains, true AS everywhere FROM y",
)
def scope_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes by options: the seed's origin and a pattern; its host and all under it, less a domain; no option at all."""
    rows = variants(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    u, seed = F.col("u"), F.col("url")
    return rows.select("page_id", "v", scope.assembled(u, seed, exclude=["ref="]).alias("same_origin"), scope.assembled(u, seed, include_subdomains=True, deny=["example.org"]).alias("subdomains"), scope.assembled(u, seed, same_origin=False).alias("everywhere"))


@R.add("retryable_error", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'timeout' WHEN 2 THEN 'too many redirects' ELSE '' END AS error, coalesce(o_orderkey % 4 IN (1, 3), false) AS retryable FROM orders")
def retryable_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transport errors may be tried again, too many redirects never."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 4 == 1, "timeout").when(k % 4 == 2, "too many redirects").when(k % 4 == 3, "").alias("error"))
    return rows.withColumn("retryable", policy.retryable(F.col("error")))


@R.add("websocket_prescan", "SELECT page_id, CASE WHEN page_id % 3 = 2 THEN '' ELSE 'wss://w.example/' || page_id END AS found FROM pages")
def websocket_prescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources without a trace of a socket are not searched, whatever else they hold."""
    i = F.col("page_id")
    body = F.when(i % 3 == 0, text('new WebSocket("wss://w.example/', i, '")')).when(i % 3 == 1, text('let a = "wss://w.example/', i, '"')).otherwise(text('let a = "https://w.example/', i, '"; websocket()'))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(extract.sockets(body, F.lit("https://o.example")), " ").alias("found"))


@R.add("attribute_last_wins", "SELECT c_custkey AS page_id, unnest(['a_href', 'base', 'img_src']) AS source, unnest([concat('/b', c_custkey), '/first/', '/i.png']) AS value FROM customer")
def attribute_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in any case; of repeated attributes the last counts, of base elements the first that is not empty."""
    k = F.col("c_custkey")
    page = text('<base href=""><base href="/first/"><base href="/second/"><a HREF="/a', k, '" href="/b', k, '">x</a><IMG SRC="" src="/i.png">')
    return html.discoveries(dealt(spark, sf_dir, "customer", "c_custkey").select(k.alias("page_id"), page.alias("html"))).select("page_id", "source", "value")


@R.add("yaml_keys", "SELECT concat('https://a', p_partkey, '.example/200') AS url, 'GET' AS method, '7,true' AS query_params FROM part")
def yaml_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and names that YAML reads as numbers or truth values are texts."""
    body = "openapi: 3.0.0\n1: one\npaths:\n  /200:\n    get:\n      parameters:\n        - {name: 7, in: query}\n        - {name: 'true', in: query}\n      responses:\n        200: {description: fine}\n"
    source = F.concat(F.lit("https://a"), F.col("p_partkey").cast("string"), F.lit(".example/spec.yaml"))
    rows = openapi.flattened(dealt(spark, sf_dir, "part", "p_partkey").select(source.alias("source_url"), F.lit(body).alias("body")))
    return rows.select("url", "method", F.array_join("query_params", ",").alias("query_params"))


@R.add("exit_codes", "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN o_orderkey % 100 ELSE -1 END::INTEGER AS code FROM orders")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a run ended: 0 without an error, its code if it ended by itself, else -1."""
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 3 > 0, "failed").alias("error"), F.when(k % 3 == 1, (k % 100).cast("int")).alias("status"))
    return runs.select("k", policy.exit_code(F.col("error"), F.col("status")).alias("code"))


@R.add("output_routes", "SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN '-' WHEN 1 THEN concat('/out/', n_nationkey) END AS out, CASE n_nationkey % 3 WHEN 0 THEN 'lines:-' WHEN 1 THEN concat('shown lines:/out/', n_nationkey) ELSE 'shown' END AS writers FROM nation")
def output_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an output option leads to."""
    k = F.col("n_nationkey")
    out = F.when(k % 3 == 0, "-").when(k % 3 == 1, text("/out/", k))
    return table(spark, sf_dir, "nation").select(k.alias("k"), out.alias("out")).withColumn("writers", F.array_join(policy.routes(F.col("out")), " "))


@R.add("request_schedule", "SELECT page_id, (row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ORDER BY page_id) * 250)::BIGINT AS start_ms FROM pages")
def request_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the requests of a host start if each waits a fixed 250 ms before it."""
    pages = table(spark, sf_dir, "pages").select("page_id", scope.host_of(F.col("url")).alias("host"))
    return numbered(pages, ["host"], ["page_id"]).select("page_id", (F.col("rank") * 250).cast("long").alias("start_ms"))


@R.add("frontier_capacity", f"{q_graph.WALK} SELECT depth, least(count(*), 20) AS queued, greatest(0, count(*) - 20) AS waiting FROM m GROUP BY depth")
def frontier_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each level's pages those that find room in a frontier of twenty, and those that wait for it."""
    level = traverse.levels(q_graph.seed(spark), q_graph.edges(spark, sf_dir), 4).groupBy("depth").agg(F.count("*").alias("n"))
    return level.select("depth", F.least("n", F.lit(20)).alias("queued"), F.greatest(F.lit(0), F.col("n") - 20).alias("waiting"))


@R.add("fetch_auxiliary", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'image/png' ELSE 'text/html' END AS content_type, strlen(html) AS bytes, page_id % 3 <> 0 AS by_crawl FROM pages")
def fetch_auxiliary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side files are taken whatever their type, where the crawl itself keeps to its list."""
    kind = F.when(F.col("page_id") % 3 == 0, "image/png").otherwise("text/html")
    rows = table(spark, sf_dir, "pages").select("page_id", kind.alias("content_type"), F.octet_length("html").cast("long").alias("bytes"))
    taken = rows.where(policy.content_allowed(F.col("content_type"), []))
    return taken.withColumn("by_crawl", policy.content_allowed(F.col("content_type")))


QUERIES, ORACLES = R.queries, R.oracles
