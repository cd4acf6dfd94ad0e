"""Queries over URL functions, scope predicates and the links of page snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.functions import scope, urls
from pagegraph.operators.ranks import numbered
from pagegraph.registry import Registry, table

R = Registry()

BASE = "regexp_replace(url, '[?#].*$', '')"
TOP = "regexp_extract(url, '^([a-z]+://[^/]*)', 1)"
REST = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '')"
#: Spellings of each page's URL, built alike in Spark and in the oracle.
VARIANTS = {
    1: "url",
    2: f"concat(upper({TOP}), {REST})",
    3: f"concat({TOP}, CASE WHEN url LIKE 'https:%' THEN ':443' ELSE ':80' END, {REST})",
    4: f"concat({BASE}, '/')",
    5: f"concat({BASE}, '#x')",
    6: f"concat({BASE}, '?b=2&a=1&b=1')",
    7: f"concat({BASE}, '/tar%67et%2F')",
    8: f"concat({BASE}, '/für x')",
    9: f"concat({BASE}, '?')",
    10: f"concat({TOP}, ':8443', {REST})",
}
VARIANT_SQL = " UNION ALL ".join(f"SELECT page_id, {k} AS v, {e} AS u FROM pages" for k, e in VARIANTS.items())
PARTS_SQL = (
    "SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS sc, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS ho, "
    "regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS pa, regexp_extract(u, '^[^?#]*(\\?[^#]*)', 1) AS qu FROM x"
)


def _encoded_sql(path: str) -> str:
    out = f"url_encode({path})"
    for c in urls.KEPT:
        out = f"replace({out}, '%{ord(c):02X}', '{c}')"
    return out


CANON_SQL = (
    f"SELECT *, CASE WHEN sc = 'http' THEN regexp_replace(ho, ':80$', '') WHEN sc = 'https' THEN regexp_replace(ho, ':443$', '') ELSE ho END AS hs, "
    f"CASE WHEN regexp_replace(url_decode(pa), '/+$', '') = '' THEN '/' ELSE {_encoded_sql("regexp_replace(url_decode(pa), '/+$', '')")} END AS pc, CASE WHEN qu = '?' THEN '' ELSE qu END AS qc FROM p"
)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    every = F.array(*[F.struct(F.lit(k).alias("v"), F.expr(e).alias("u")) for k, e in VARIANTS.items()])
    return rows.select("page_id", F.inline(every))


@R.add("canonicalize_url", f"WITH x AS ({VARIANT_SQL}), p AS ({PARTS_SQL}), c AS ({CANON_SQL}) SELECT page_id, v, concat(sc, '://', hs, pc, qc) AS strict, concat(sc, '://', ho, pc, qc) AS legacy FROM c")
def canonicalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("page_id", "v", urls.canonicalize(F.col("u")).alias("strict"), urls.canonicalize(F.col("u"), strict=False).alias("legacy"))


@R.add("strip_default_port", f"WITH x AS ({VARIANT_SQL}), p AS ({PARTS_SQL}), c AS ({CANON_SQL}) SELECT page_id, v, hs AS host FROM c")
def strip_default_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = urls.split_url(F.col("u"))
    return variants(spark, sf_dir).select("page_id", "v", urls.strip_default_port(u.scheme, F.lower(u.host)).alias("host"))


QUERY_CASES = "SELECT c_custkey AS k, concat('z=', c_nationkey, '&a=', c_custkey % 7, '&b=x+y&a=', c_custkey % 3, '&empty=&m=', replace(c_mktsegment, ' ', '%20')) AS q FROM customer"


@R.add(
    "sort_query",
    f"WITH x AS ({QUERY_CASES}), e AS (SELECT k, q, unnest(string_split(q, '&')) AS part FROM x), d AS (SELECT k, q, string_split(part, '=')[1] AS a, url_decode(replace(string_split(part, '=')[2], '+', ' ')) AS b FROM e) "
    "SELECT k, q, string_agg(concat(a, '=', replace(url_encode(b), '%20', '+')), '&' ORDER BY a, b) AS sorted FROM d GROUP BY k, q",
)
def sort_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(QUERY_CASES).select("k", "q", urls.sorted_query(F.col("q")).alias("sorted"))


#: References resolved against page URLs.
REFS = {1: "/abs/path", 2: "rel/x", 3: "../up", 4: "./here/./there", 5: "?q=1", 6: "#frag", 7: "//other.example/p", 8: "https://full.example/a/../b", 9: "a/b/../../c", 10: "/für"}
REF_SQL = " UNION ALL ".join(f"SELECT page_id, {k} AS r, url AS b, '{e}' AS ref FROM pages" for k, e in REFS.items())
DOTLESS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '/(\\./)+', '/', 'g'), '/[^/]+/\\.\\./', '/'), '/[^/]+/\\.\\./', '/'), '^(/\\.\\.)+/', '/')"


@R.add(
    "resolve_url",
    f"WITH x AS ({REF_SQL}), p AS (SELECT *, regexp_extract(b, '^([a-z]+)://', 1) AS sc, regexp_extract(b, '^[a-z]+(://[^/?#]*)', 1) AS au, regexp_extract(b, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS pa, regexp_extract(b, '^[^?#]*(\\?[^#]*)', 1) AS qu FROM x), "
    "q AS (SELECT *, CASE WHEN ref LIKE 'https:%' THEN regexp_extract(ref, '^[a-z]+://[^/]*(.*)', 1) WHEN ref LIKE '//%' THEN regexp_extract(ref, '^//[^/]*(.*)', 1) WHEN ref LIKE '/%' THEN ref ELSE concat(regexp_replace(pa, '[^/]*$', ''), ref) END AS m FROM p) "
    f"SELECT page_id, r, CASE WHEN ref LIKE 'https:%' THEN concat('https', '://full.example', {DOTLESS}) WHEN ref LIKE '//%' THEN concat(sc, '://other.example', {DOTLESS}) "
    f"WHEN ref LIKE '?%' THEN concat(sc, au, pa, ref) WHEN ref LIKE '#%' THEN concat(sc, au, pa, qu) ELSE concat(sc, au, replace({DOTLESS}, 'ü', '%C3%BC')) END AS resolved FROM q",
)
def resolve_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.array(*[F.struct(F.lit(k).alias("r"), F.lit(e).alias("ref")) for k, e in REFS.items()])
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.inline(refs))
    return rows.select("page_id", "r", urls.resolve(F.col("url"), F.col("ref")).alias("resolved"))


HREFS = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'javascript:void(0)' WHEN 1 THEN 'mailto:a@b.example' WHEN 2 THEN '#top' WHEN 3 THEN 'JavaScript:x' WHEN 4 THEN '/ok' ELSE url END AS href FROM pages"


@R.add("skip_href", f"SELECT page_id, href, starts_with(href, 'javascript:') OR starts_with(href, 'mailto:') OR starts_with(href, '#') AS skipped FROM ({HREFS})")
def skip_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return spark.sql(HREFS).select("page_id", "href", urls.skippable(F.col("href")).alias("skipped"))


REFRESH = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('0; url=', url) WHEN 1 THEN concat('5;URL=''/next/', page_id, '''') WHEN 2 THEN '10' WHEN 3 THEN concat('1; Url = \"', url, '\"') ELSE '3; link=/x' END AS content FROM pages"


@R.add("meta_refresh", f"SELECT page_id, trim(trim(regexp_extract(content, '^[^;]*;\\s*(?i:url)\\s*=\\s*(.*)$', 1)), '\"''') AS target FROM ({REFRESH})")
def meta_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return spark.sql(REFRESH.replace("''/next/", "\\'/next/").replace(", '''')", ", '\\'')")).select("page_id", urls.meta_refresh_url(F.col("content")).alias("target"))


@R.add("strip_port", f"WITH x AS ({VARIANT_SQL}), p AS ({PARTS_SQL}) SELECT page_id, v, regexp_replace(ho, ':[^:]*$', '') AS host FROM p")
def strip_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("page_id", "v", urls.strip_port(scope.host_of(F.col("u"))).alias("host"))


@R.add("url_origin", f"WITH x AS ({VARIANT_SQL}) SELECT page_id, v, concat(lower(regexp_extract(u, '^([A-Za-z]+):', 1)), '://', regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)) AS origin FROM x")
def url_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("page_id", "v", urls.origin(F.col("u")).alias("origin"))


@R.add("query_param_count", f"WITH x AS ({VARIANT_SQL}), q AS (SELECT page_id, v, regexp_extract(u, '\\?([^#]*)', 1) AS q FROM x) SELECT page_id, v, len(list_distinct(list_transform(list_filter(string_split(q, '&'), lambda p: p <> ''), lambda p: string_split(p, '=')[1])))::INTEGER AS n FROM q")
def query_param_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("page_id", "v", urls.query_key_count(F.col("u")).alias("n"))


TARGETS = "SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN '/api/x' WHEN 1 THEN 'rest/y' ELSE 'https://z.example/api/w' END AS target FROM pages"


@R.add("join_origin", f"SELECT page_id, CASE WHEN target LIKE 'http%' THEN target ELSE concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), CASE WHEN target LIKE '/%' THEN '' ELSE '/' END, target) END AS joined FROM ({TARGETS})")
def join_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return spark.sql(TARGETS).select("page_id", urls.join_origin(urls.origin(F.col("url")), F.col("target")).alias("joined"))


ASSET_SQL = "SELECT page_id, concat(regexp_replace(url, '[?#].*$', ''), CASE page_id % 6 WHEN 0 THEN '.JS' WHEN 1 THEN '.css?v=1' WHEN 2 THEN '/index.html' WHEN 3 THEN '' WHEN 4 THEN '.tar.gz' ELSE '.woff2#x' END) AS u FROM pages"
ASSET_LIST = ", ".join(f"'{a}'" for a in urls.ASSETS)


@R.add("is_asset", f"SELECT page_id, u, lower(regexp_extract(regexp_replace(u, '[?#].*$', ''), '://[^/]*/.*\\.([^./]*)$', 1)) IN ({ASSET_LIST}) AS asset FROM ({ASSET_SQL})")
def is_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return spark.sql(ASSET_SQL).select("page_id", "u", urls.is_asset(F.col("u")).alias("asset"))


@R.add("render_select", f"SELECT page_id, CASE WHEN lower(regexp_extract(regexp_replace(u, '[?#].*$', ''), '://[^/]*/.*\\.([^./]*)$', 1)) IN ({ASSET_LIST}) THEN 'plain' ELSE 'rendered' END AS source FROM ({ASSET_SQL})")
def render_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return spark.sql(ASSET_SQL).select("page_id", F.when(urls.is_asset(F.col("u")), "plain").otherwise("rendered").alias("source"))


@R.add("scope_exact_origin", f"WITH x AS ({VARIANT_SQL}), o AS (SELECT page_id, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) AS seed FROM pages) SELECT x.page_id, v, lower(regexp_extract(u, '^([A-Za-z]+://[^/?#]*)', 1)) = seed AS in_scope FROM x JOIN o USING (page_id)")
def scope_exact_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variants(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    return rows.select("page_id", "v", scope.exact_origin(F.col("u"), F.col("url")).alias("in_scope"))


HOST_SQL = "lower(regexp_extract(u, '^[A-Za-z]+://([^/?#:]*)', 1))"


@R.add("scope_subdomain", f"WITH x AS ({VARIANT_SQL}) SELECT page_id, v, {HOST_SQL} = 'example.com' OR suffix({HOST_SQL}, '.example.com') AS in_scope FROM x")
def scope_subdomain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("page_id", "v", scope.subdomain(F.col("u"), F.lit("example.com")).alias("in_scope"))


ALLOW, DENY = ["example.com", "example.org"], ["blog.example.com", "m.ththth.example.net"]
_under = lambda names: " OR ".join(f"{HOST_SQL} = '{n}' OR suffix({HOST_SQL}, '.{n}')" for n in names)


@R.add("scope_allow_deny", f"WITH x AS ({VARIANT_SQL}) SELECT page_id, v, NOT ({_under(DENY)}) AND ({_under(ALLOW)}) AS in_scope FROM x")
def scope_allow_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("page_id", "v", scope.allow_deny(F.col("u"), ALLOW, DENY).alias("in_scope"))


INCLUDE, EXCLUDE = ["/(en|de)/", "page="], ["ref=", "[0-9]{3}$"]


@R.add("scope_regex", f"WITH x AS ({VARIANT_SQL}) SELECT page_id, v, NOT ({' OR '.join(f"regexp_matches(u, '{p}')" for p in EXCLUDE)}) AND ({' OR '.join(f"regexp_matches(u, '{p}')" for p in INCLUDE)}) AS in_scope FROM x")
def scope_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("page_id", "v", scope.patterns(F.col("u"), INCLUDE, EXCLUDE).alias("in_scope"))


@R.add("scope_composite", f"WITH x AS ({VARIANT_SQL}) SELECT page_id, v, ({HOST_SQL} = 'example.com' OR suffix({HOST_SQL}, '.example.com')) AND NOT regexp_matches(u, 'ref=') AND NOT ({_under(DENY)}) AS in_scope FROM x")
def scope_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    return variants(spark, sf_dir).select("page_id", "v", scope.composite(scope.subdomain(u, F.lit("example.com")), scope.patterns(u, [], ["ref="]), scope.allow_deny(u, [], DENY)).alias("in_scope"))


# Links of the page snapshots.
HREF = '<a[^>]*\\shref="([^"]*)"'
LINK_SQL = (
    f"WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href, generate_subscripts(regexp_extract_all(html, '{HREF}', 1), 1) AS ord FROM pages), "
    "k AS (SELECT page_id, url, ord, replace(href, '&amp;', '&') AS href FROM l), "
    f"z AS (SELECT *, concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), {_encoded_sql('url_decode(href)')}) AS target FROM k WHERE href LIKE '/%')"
)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, ord, href, target) of the anchors of each page, in order; hrefs that lead nowhere are left out."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("ord", "href"))
    rows = rows.select("page_id", "url", (F.col("ord") + 1).alias("ord"), F.replace("href", F.lit("&amp;"), F.lit("&")).alias("href"))
    # The generator keeps what follows above it: filters and columns read the target, and do not resolve it anew.
    return rows.where(~urls.skippable(F.col("href"))).select("*", F.inline(F.array(F.struct(urls.resolve(F.col("url"), F.col("href")).alias("target")))))


@R.add("links_a", f"{LINK_SQL} SELECT page_id, ord::INTEGER AS ord, href, target FROM z")
def links_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).select("page_id", "ord", "href", "target")


@R.add("flagship_host_summary", f"{LINK_SQL} SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(DISTINCT page_id) AS pages, count(*) AS urls_discovered, count(DISTINCT regexp_replace(target, '(.)/+$', '\\1')) AS urls_unique, count(*) - count(DISTINCT regexp_replace(target, '(.)/+$', '\\1')) AS duplicates_rejected FROM z GROUP BY 1")
def flagship_host_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: pages with links, URLs found, different ones in scope, and duplicates."""
    rows = page_links(spark, sf_dir).where(scope.exact_origin(F.col("target"), F.col("url")))
    rows = rows.select("page_id", scope.host_of(F.col("url")).alias("host"), urls.canonicalize(F.col("target")).alias("target"))
    # One scan: rows are dealt by host and value, which are different ones after the first sums, so a hot host is no single task.
    out = rows.groupBy("host").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("urls_discovered"), F.count_distinct("target").alias("urls_unique"))
    return out.withColumn("duplicates_rejected", F.col("urls_discovered") - F.col("urls_unique"))


@R.add("urls_discovered", f"{LINK_SQL} SELECT count(*) AS urls_discovered, count(DISTINCT target) AS urls_unique FROM z")
def urls_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).agg(F.count("*").alias("urls_discovered"), F.count_distinct("target").alias("urls_unique"))


@R.add("urls_unique", f"{LINK_SQL} SELECT regexp_extract(target, '^[a-z]+://([^/]*)', 1) AS host, count(DISTINCT target) AS urls_unique FROM z GROUP BY 1")
def urls_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).groupBy(scope.host_of(F.col("target")).alias("host")).agg(F.count_distinct("target").alias("urls_unique"))


@R.add("dedup_anti", f"{LINK_SQL} SELECT DISTINCT target AS url FROM z WHERE target NOT IN (SELECT target FROM z WHERE page_id % 3 = 0)")
def dedup_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = page_links(spark, sf_dir)
    visited = links.where("page_id % 3 = 0").select(F.col("target").alias("url"))
    return links.select(F.col("target").alias("url")).join(visited, "url", "left_anti").distinct()


@R.add("duplicates_rejected", f"{LINK_SQL} SELECT count(*) - count(DISTINCT target) AS duplicates_rejected FROM z")
def duplicates_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n")).agg((F.sum("n") - F.count("*")).alias("duplicates_rejected"))


@R.add("url_distinct", f"WITH x AS ({VARIANT_SQL}), p AS ({PARTS_SQL}), c AS ({CANON_SQL}) SELECT concat(sc, '://', hs, pc, qc) AS url, count(*) AS spellings FROM c GROUP BY 1")
def url_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).groupBy(urls.canonicalize(F.col("u")).alias("url")).agg(F.count("*").alias("spellings"))


@R.add("first_discovery", f"{LINK_SQL} SELECT target AS url, arg_min(page_id, (page_id, ord)) AS parent, min((page_id * 1000000 + ord))::BIGINT % 1000000 AS ord FROM z GROUP BY target")
def first_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = page_links(spark, sf_dir).groupBy(F.col("target").alias("url")).agg(F.min(F.struct("page_id", "ord")).alias("f"))
    return first.select("url", F.col("f.page_id").alias("parent"), F.col("f.ord").cast("long").alias("ord"))


@R.add("seed_frontier", f"WITH x AS (SELECT page_id, 1 AS v, url AS u FROM pages), p AS ({PARTS_SQL}), c AS ({CANON_SQL}) SELECT DISTINCT concat(sc, '://', hs, pc, qc) AS url, '' AS parent_url, 0 AS depth, 'seed' AS via FROM c")
def seed_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "pages").select(urls.canonicalize(F.col("url")).alias("url")).distinct()
    return seeds.select("url", F.lit("").alias("parent_url"), F.lit(0).alias("depth"), F.lit("seed").alias("via"))


@R.add("host_waves", "SELECT page_id, floor((row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ORDER BY page_id) - 1) / 4)::BIGINT AS wave FROM pages")
def host_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves of at most four pages of a host at a time; a host may have most of the pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", scope.host_of(F.col("url")).alias("host"))
    return numbered(pages, ["host"], ["page_id"]).select("page_id", F.floor((F.col("rank") - 1) / 4).alias("wave"))


QUERIES, ORACLES = R.queries, R.oracles
