"""Queries over sitemaps, rendered sites, the output of other crawlers, and encoded events.

Robots files, sitemaps and lines that the test tables lack are built from their keys, alike in the query and in its twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.functions import policy
from pagegraph.operators import sitemaps, sites
from pagegraph.plans import q_stats
from pagegraph.registry import Registry, table
from pagegraph.sources import tool_output

R = Registry()


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Four kinds of sites, by the supplier's key: a urlset in the usual place; two named in robots, one an index; a broken one; a long index.
K = lambda: F.col("s_suppkey")
CHILDREN = 60


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(K(), text("https://s", K(), ".example").alias("origin"))


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("origin")
    body = F.when(K() % 4 == 1, text("﻿User-agent: *\nSITEMAP: ", o, "/a.xml # first\nSitemap: /relative.xml\n  sitemap:", o, "/b.xml\n")).otherwise("User-agent: *\nDisallow:\n")
    return origins(spark, sf_dir).select("origin", body.alias("body"))


def sitemap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("origin")
    many = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(CHILDREN - 1)), lambda i: text("<sitemap><loc>", o, "/d", i, ".xml</loc></sitemap>")), "")
    doc = lambda name, body, status=200: F.struct(text(o, name).alias("url"), F.lit(status).alias("status"), body.alias("body"))
    locs = lambda *paths: text(*[x for p in paths for x in ("<url><loc>", o, p, "</loc></url>")])
    wrap = lambda inner: text('<?xml version="1.0"?><!-- map --><urlset xmlns="x">', inner, "</urlset>")
    kinds = {
        0: [doc("/sitemap.xml", wrap(text("<url><loc> ", o, "/Home/ \n</loc></url><url><loc>/relative</loc></url><url><loc></loc></url>", locs("/about", "/Home"))))],
        1: [
            doc("/a.xml", text("<sitemapindex><sitemap><loc>", o, "/c.xml</loc></sitemap><url><loc>", o, "/never</loc></url><sitemap><loc>", o, "/b.xml</loc></sitemap><sitemap><loc>", o, "/gone.xml</loc></sitemap></sitemapindex>")),
            doc("/b.xml", wrap(text(locs("/b1", "/b2"), "<url><loc>https://else.example/x</loc></url>"))), doc("/c.xml", wrap(locs("/c1", "/b1"))), doc("/gone.xml", wrap(locs("/gone")), 404), doc("/sitemap.xml", wrap(locs("/unused"))),
        ],
        2: [doc("/sitemap.xml", F.lit("<urlset><url>"))],
        3: [doc("/sitemap.xml", text("<SitemapIndex>", many, "</SitemapIndex>"))],
    }
    base = origins(spark, sf_dir)
    rows = None
    for rest, docs in kinds.items():
        part = base.where(K() % 4 == rest).select(F.inline(F.array(*docs)))
        rows = part if rows is None else rows.union(part)
    children = base.where(K() % 4 == 3).select(o, F.explode(F.sequence(F.lit(0), F.lit(CHILDREN - 1))).alias("i"))
    return rows.union(children.select(text(o, "/d", F.col("i"), ".xml"), F.lit(200), wrap(text("<url><loc>", o, "/p", F.col("i"), "</loc></url>"))))


S = "concat('https://s', s_suppkey, '.example"


def _locs(limit: int) -> str:
    """The locations by kind of site; of the long index only fifty children have a place, and fewer are read with a limit."""
    some = min(limit or 50, 50)
    rows = [
        f"SELECT {S}') AS origin, 0 AS place, unnest([0, 1, 2]) AS ord, unnest([{S}/Home/'), {S}/about'), {S}/Home')]) AS loc FROM supplier WHERE s_suppkey % 4 = 0",
        f"SELECT {S}'), 1, unnest([0, 1, 2]), unnest([{S}/b1'), {S}/b2'), 'https://else.example/x']) FROM supplier WHERE s_suppkey % 4 = 1",
        f"SELECT {S}'), i + 1, 0, {S}/p', i) FROM supplier, (SELECT unnest(range({some})) AS i) WHERE s_suppkey % 4 = 3",
    ]
    if not limit or limit > 3:
        rows.append(f"SELECT {S}'), 2, unnest([0, 1]), unnest([{S}/c1'), {S}/b1')]) FROM supplier WHERE s_suppkey % 4 = 1")
    return " UNION ALL ".join(rows)


@R.add("sitemap_seeds", f"SELECT origin, place::INTEGER AS place, ord::INTEGER AS ord, loc FROM ({_locs(0)})")
def sitemap_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All locations of each origin's sitemaps."""
    return sitemaps.discovered(origins(spark, sf_dir).select("origin"), robots_files(spark, sf_dir), sitemap_documents(spark, sf_dir))


@R.add("sitemap_limit", f"SELECT origin, count(*) AS locations, max(place)::INTEGER AS last_place FROM ({_locs(3)}) GROUP BY origin")
def sitemap_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit of three: it is looked at between documents, so the last one is taken whole."""
    locs = sitemaps.discovered(origins(spark, sf_dir).select("origin"), robots_files(spark, sf_dir), sitemap_documents(spark, sf_dir), 3)
    return locs.groupBy("origin").agg(F.count("*").alias("locations"), F.max("place").alias("last_place"))


@R.add(
    "sitemap_frontier",
    f"WITH l AS (SELECT *, CASE WHEN loc LIKE '%/Home/' THEN rtrim(loc, '/') ELSE loc END AS url FROM ({_locs(4)}) WHERE starts_with(loc, origin)), u AS (SELECT origin, url, min(place * 1000 + ord) AS spot FROM l GROUP BY 1, 2) "
    "SELECT origin, url, concat(origin, '/') AS parent_url, 0 AS depth, 'sitemap' AS via FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY spot) AS k FROM u) WHERE k <= 4",
)
def sitemap_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds for a frontier of five places, one of which the seed has, and ten pages."""
    locs = sitemaps.discovered(origins(spark, sf_dir).select("origin"), robots_files(spark, sf_dir), sitemap_documents(spark, sf_dir), 4)
    return sitemaps.seeds(locs, 5, 10)


C = lambda: F.col("c_custkey")


@R.add(
    "site_render",
    "SELECT c_custkey AS k, concat('<html><body>\n<a href=\"/p', c_custkey, '\">link0</a>\n<a href=\"', CASE WHEN c_custkey % 2 = 0 THEN 'https://b.example' ELSE '' END, '/x\\\"y\">link1</a>\n<script src=\"/app.js\"></script>\n<div data-href=\"/d', c_custkey, '\">datalink0</div>\n', "
    "CASE WHEN c_custkey % 3 = 0 THEN concat('<form action=\"/find\" method=\"get\">\n<input type=\"text\" name=\"q\">\n<input type=\"text\" name=\"n', c_custkey, '\">\n<input type=\"submit\" value=\"go0\">\n</form>\n') ELSE '' END, CASE WHEN c_custkey % 5 = 0 THEN concat('<!--', repeat('x', 1024), '-->\n') ELSE '' END, '</body></html>\n') AS html FROM customer",
)
def site_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = F.create_map(F.lit("a"), F.lit("https://a.example"), F.lit("b"), F.lit("https://b.example"))
    own = F.when(C() % 2 == 0, "a").otherwise("b")
    links = F.array(sites.linked(text("/p", C()), hosts, own), sites.linked(F.lit('b:/x"y'), hosts, own))
    form = F.struct(F.lit("/find").alias("action"), F.lit("").alias("method"), F.array(F.lit("q"), text("n", C())).alias("fields"))
    forms = F.when(C() % 3 == 0, F.array(form)).otherwise(F.array().cast("array<struct<action:string,method:string,fields:array<string>>>"))
    page = sites.html_page(links, F.array(F.lit("/app.js")), F.array(text("/d", C())), forms, F.when(C() % 5 == 0, 1).otherwise(0))
    return table(spark, sf_dir, "customer").select(C().alias("k"), page.alias("html"))


@R.add("site_script", "SELECT c_custkey AS k, concat('this.http.', CASE WHEN c_custkey % 2 = 0 THEN 'delete' ELSE 'get' END, '(\"/api/v', c_custkey, '\");\nthis.http.get(\"/rest/all\");\n') AS script FROM customer")
def site_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = F.array(F.struct(F.when(C() % 2 == 0, "DELETE").otherwise("").alias("method"), text("/api/v", C()).alias("path")), F.struct(F.lit("GET").alias("method"), F.lit("/rest/all").alias("path")))
    return table(spark, sf_dir, "customer").select(C().alias("k"), sites.script_page(calls).alias("script"))


@R.add(
    "site_serve",
    "SELECT o_orderkey AS id, 'h' AS host, CASE WHEN o_custkey % 7 = 0 THEN '/no' ELSE concat('/p', o_custkey % 6) END AS path, (o_orderkey % 3)::INTEGER AS attempt, "
    "(CASE WHEN o_custkey % 7 = 0 THEN 404 WHEN o_custkey % 6 = 1 AND o_orderkey % 3 < 2 THEN 503 WHEN o_custkey % 6 = 2 AND o_orderkey % 3 < 1 THEN 429 WHEN o_custkey % 6 = 3 THEN 301 WHEN o_custkey % 6 = 4 THEN 410 ELSE 200 END)::INTEGER AS answer, "
    "CASE WHEN o_custkey % 7 <> 0 AND o_custkey % 6 = 3 THEN '/p0' END AS location, CASE WHEN o_custkey % 7 <> 0 AND o_custkey % 6 <> 3 AND NOT (o_custkey % 6 = 1 AND o_orderkey % 3 < 2) AND NOT (o_custkey % 6 = 2 AND o_orderkey % 3 < 1) THEN concat('body ', o_custkey % 6) END AS body FROM orders",
)
def site_serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against a site of six pages: plain ones, two that fail at first, a redirect and one that is gone."""
    pages = [("h", f"/p{k}", "/p0" if k == 3 else "", 410 if k == 4 else 0, {1: 2, 2: 1}.get(k, 0), 429 if k == 2 else 0, f"body {k}") for k in range(6)]
    site = spark.createDataFrame(pages, "host string, path string, redirect string, status int, fail_first int, fail_status int, body string")
    path = F.when(F.col("o_custkey") % 7 == 0, "/no").otherwise(text("/p", F.col("o_custkey") % 6))
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("h").alias("host"), path.alias("path"), (F.col("o_orderkey") % 3).cast("int").alias("attempt"))
    return sites.served(requests, F.broadcast(site))  # six rows, always


# The twenty workloads, built from the same parameters in SQL.
WORK = (
    f"RECURSIVE w(workload, shape, n, width, moved_every, failed_every) AS (VALUES {', '.join(map(str, sites.WORKLOADS))}), k AS (SELECT *, unnest(range(n)) AS page FROM w), "
    "p AS (SELECT *, CASE WHEN page > 0 AND failed_every > 0 AND page % greatest(failed_every, 1) = failed_every - 1 THEN 503 WHEN page > 0 AND moved_every > 0 AND page % greatest(moved_every, 1) = moved_every - 1 THEN 301 ELSE 200 END AS status FROM k), "
    "l AS (SELECT workload, page AS src, page + 1 AS dst, 0 AS ord, status FROM p WHERE shape = 'chain' AND page + 1 < n UNION ALL SELECT workload, page, unnest(range(1, n)), unnest(range(n - 1)), status FROM p WHERE shape = 'fan' AND page = 0 "
    "UNION ALL SELECT p.workload, page, page * width + 1 + i, i, status FROM p, (SELECT unnest(range(20)) AS i) WHERE shape = 'tree' AND i < width AND page * width + 1 + i < n UNION ALL SELECT workload, page, (page + 1) % n, 0, status FROM p WHERE shape = 'ring' "
    "UNION ALL SELECT workload, page, page + 1, 0, status FROM p WHERE shape = 'grid' AND page % width < width - 1 AND page + 1 < n UNION ALL SELECT workload, page, page + width, CASE WHEN page % width < width - 1 AND page + 1 < n THEN 1 ELSE 0 END, status FROM p WHERE shape = 'grid' AND page + width < n "
    "UNION ALL SELECT workload, page, (page * 7 + 3) % n, 0, status FROM p WHERE shape = 'web' UNION ALL SELECT workload, page, (page * 11 + 5) % n, 1, status FROM p WHERE shape = 'web'), "
    "e AS (SELECT * FROM l WHERE status = 200 OR (status = 301 AND ord = 0))"
)


@R.add("workload_pages", f"WITH {WORK} SELECT workload, count(*) AS pages, count(*) FILTER (status = 301) AS moved, count(*) FILTER (status = 503) AS failing FROM p GROUP BY workload")
def workload_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.workload_pages(spark).groupBy("workload").agg(F.count("*").alias("pages"), F.count_if(F.col("status") == 301).alias("moved"), F.count_if(F.col("status") == 503).alias("failing"))


@R.add("workload_links", f"WITH {WORK} SELECT workload, src, dst, ord::INTEGER AS ord FROM e")
def workload_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.workload_links(spark)


@R.add("workload_reach", f"WITH {WORK}, r AS (SELECT workload, 0::BIGINT AS page, 0 AS depth FROM w UNION SELECT e.workload, e.dst, r.depth + 1 FROM r JOIN e ON e.workload = r.workload AND e.src = r.page WHERE r.depth < 12), m AS (SELECT workload, page, min(depth) AS depth FROM r GROUP BY 1, 2) SELECT workload, count(*) AS reached, max(depth)::INTEGER AS deepest FROM m GROUP BY workload")
def workload_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl of twelve levels gets to in each workload."""
    from pagegraph.operators import traverse

    key = lambda c: F.struct("workload", F.col(c).alias("page"))
    edges = sites.workload_links(spark).select(key("src").alias("src"), key("dst").alias("dst"))
    seeds = sites.workload_pages(spark).where("page = 0").select(key("page").alias("url"))
    reached = traverse.levels(seeds, edges, 12).select("url.workload", "depth")
    return reached.groupBy("workload").agg(F.count("*").alias("reached"), F.max("depth").alias("deepest"))


# Output of other crawlers: three lines for each customer, in runs of a nation.
N = lambda: F.col("c_nationkey")
RUN = "c_nationkey AS run"


def _lines(spark: SparkSession, sf_dir: str, *lines: Column) -> DataFrame:
    return table(spark, sf_dir, "customer").select(N().alias("run"), text("https://n", N(), ".example/home/").alias("seed"), F.explode(F.array(*lines)).alias("line"))


SEEDS = f"SELECT {RUN}, concat('https://n', c_nationkey, '.example/home/') AS url FROM customer"


@R.add("parse_tool_events", f"SELECT DISTINCT {RUN}, concat('https://h/', c_custkey % 10) AS url FROM customer")
def parse_tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_output.event_lines(_lines(spark, sf_dir, text('{"type":"page","url":"https://h/', C() % 10, '"}'), text('{"type":"error","url":"https://h/e', C(), '"}'), F.lit('{"type":"page"}'), F.lit("{half"), F.lit("")))


@R.add("parse_tool_requests", f"SELECT DISTINCT {RUN}, concat('https://h/', c_custkey % 10) AS url FROM customer")
def parse_tool_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_output.request_lines(_lines(spark, sf_dir, text('{"request":{"endpoint":"https://h/', C() % 10, '"},"x":1}'), text('{"endpoint":"https://h/no', C(), '"}'), F.lit('{"request":{}}'), F.lit("[INF] done")))


@R.add("parse_tool_flat", f"SELECT DISTINCT {RUN}, concat('https://h/', c_custkey % 10) AS url FROM customer UNION {SEEDS}")
def parse_tool_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_output.flat_lines(_lines(spark, sf_dir, text('{"Source":"href","URL":"https://h/', C() % 10, '"}'), F.lit('{"URL":""}'), F.lit("oops")))


@R.add("parse_tool_brackets", f"SELECT DISTINCT {RUN}, unnest([concat('https://h/', c_custkey % 10), concat('https://n', c_nationkey, '.example/api/', c_custkey % 4), concat('https://n', c_nationkey, '.example/home/app.js')]) AS url FROM customer UNION {SEEDS}")
def parse_tool_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text("[url] - [code-200] - https://h/", C() % 10), text("  [linkfinder] - [from: https://h/app.js] - /api/", C() % 4, " "), F.lit("[javascript] - app.js"), text("[form] - https://h/f", C()), F.lit("[subdomains] - https://x.example")
    return tool_output.bracket_lines(_lines(spark, sf_dir, *lines))


@R.add("tool_summary", f"SELECT {RUN}, CASE WHEN c_nationkey % 2 = 0 THEN 5000 ELSE 0 END::BIGINT AS active_wall_ns, 0::BIGINT AS retry_backoff_ns, CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS retry_attempts, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey ELSE 0 END::BIGINT AS requests_made, 0::BIGINT AS responses_ok, sum(c_custkey)::BIGINT AS bytes_received, c_nationkey % 2 = 0 AS ok FROM customer GROUP BY c_nationkey")
def tool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.when(N() % 2 == 0, text('{"type":"summary","active_wall_ns":5000,"retry_attempts":2,"requests_made":', N(), "}")).otherwise("")
    return tool_output.run_summary(_lines(spark, sf_dir, text('{"type":"page","url":"u","bytes_read":', C(), "}"), last))


# Encoded events: nested fields keep their names, what is null stays null.
def _json(column: Column) -> Column:
    return policy.html_safe_json(F.to_json(column, {"ignoreNullFields": "false"}))


@R.add(
    "encode_discovery",
    "SELECT c_custkey AS k, concat('{\"Kind\":\"form\",\"URL\":\"/f?a=1\\u0026k=', c_custkey, '\",\"Method\":\"POST\",\"Params\":', CASE WHEN c_custkey % 3 = 0 THEN 'null' WHEN c_custkey % 3 = 1 THEN '[]' ELSE concat('[{\"Name\":\"q\",\"Value\":\"\\u003c', c_custkey, '\\u003e\"},{\"Name\":\"r\",\"Value\":\"\"}]') END, "
    "',\"Base\":{\"a\":\"1\",\"z\":\"', c_custkey, '\"},\"Meta\":null}') AS line FROM customer",
)
def encode_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda n, v: F.struct(F.lit(n).alias("Name"), v.alias("Value"))
    kind = "array<struct<Name:string,Value:string>>"
    params = F.when(C() % 3 == 0, F.lit(None).cast(kind)).when(C() % 3 == 1, F.array().cast(kind)).otherwise(F.array(pair("q", text("<", C(), ">")), pair("r", F.lit(""))))
    base = F.map_from_entries(F.array_sort(F.map_entries(F.create_map(F.lit("z"), C().cast("string"), F.lit("a"), F.lit("1")))))
    row = F.struct(F.lit("form").alias("Kind"), text("/f?a=1&k=", C()).alias("URL"), F.lit("POST").alias("Method"), params.alias("Params"), base.alias("Base"), F.lit(None).cast("map<string,string>").alias("Meta"))
    return table(spark, sf_dir, "customer").select(C().alias("k"), _json(row).alias("line"))


@R.add(
    "encode_openapi",
    "SELECT p_partkey AS k, concat('{\"type\":\"openapi\",\"source_url\":\"https://a/', p_partkey, '\",\"endpoints\":[{\"URL\":\"https://a/x\",\"Method\":\"GET\",\"PathParams\":null,\"QueryParams\":[\"q\"],\"BodyParams\":[],\"RawPath\":\"/x\"}]}') AS line FROM part",
)
def encode_openapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.lit(None).cast("array<string>"), F.array(F.lit("q")), F.array().cast("array<string>")
    one = F.struct(F.lit("https://a/x").alias("URL"), F.lit("GET").alias("Method"), names[0].alias("PathParams"), names[1].alias("QueryParams"), names[2].alias("BodyParams"), F.lit("/x").alias("RawPath"))
    row = F.struct(F.lit("openapi").alias("type"), text("https://a/", F.col("p_partkey")).alias("source_url"), F.array(one).alias("endpoints"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), _json(row).alias("line"))


#: The counters of a summary line, in their order.
COUNTERS = [
    "urls_discovered_total", "urls_unique", "urls_in_scope_unique", "endpoints_discovered", "params_discovered", "forms_discovered", "js_files_discovered", "js_routes_discovered", "requests_made", "responses_ok", "responses_failed",
    "redirects_followed", "duplicates_rejected", "robots_disallowed", "source_maps_recovered", "openapi_endpoints_discovered", "sitemap_urls_seeded", "retry_attempts", "retry_backoff_ns", "active_wall_ns", "retry_backoff_ms", "active_wall_ms",
]


def summary_line(seed: Column, partial: Column, duration_ns: Column, duration: Column, counters: dict[str, Column], per_sec: Column, useful_per_sec: Column, memory: Column) -> Column:
    """The summary of a crawl as an event line; counters that are not given are 0."""
    numbers = "".join(f',"{n}":%s' for n in COUNTERS)
    values = [counters.get(n, F.lit(0)).cast("string") for n in COUNTERS]
    string = lambda c: policy.html_safe_json(F.regexp_extract(F.to_json(F.array(c)), "(?s)^\\[(.*)\\]$", 1))
    head = F.concat(F.lit('{"type":"summary","seed":'), string(seed), F.when(partial, ',"partial":true').otherwise(""), F.lit(',"duration_ns":'), duration_ns.cast("string"), F.lit(',"duration":'), string(duration))
    rest = F.concat(F.lit(',"urls_per_sec":'), policy.json_number(per_sec), F.lit(',"useful_unique_discoveries_per_sec":'), policy.json_number(useful_per_sec), F.lit(',"peak_memory_bytes":'), memory.cast("string"), F.lit("}"))
    return F.concat(head, F.format_string(numbers, *values), rest)


ZEROS = "".join(f"',\"{n}\":', " + {"requests_made": "n, ", "urls_unique": "n * 2, "}.get(n, "0, ") for n in COUNTERS)


@R.add(
    "encode_summary",
    f"WITH s AS (SELECT user_id % 40 AS host, count(*) AS n FROM events GROUP BY 1) SELECT host, concat('{{\"type\":\"summary\",\"seed\":\"https://h', host, '/?a\\u0026b\"', CASE WHEN host % 4 = 0 THEN ',\"partial\":true' ELSE '' END, ',\"duration_ns\":', n * 1000, ',\"duration\":\"', n, 'µs\"', "
    f"{ZEROS}',\"urls_per_sec\":', n // 4, CASE n % 4 WHEN 1 THEN '.25' WHEN 2 THEN '.5' WHEN 3 THEN '.75' ELSE '' END, ',\"useful_unique_discoveries_per_sec\":', CASE WHEN host % 2 = 0 THEN '0' ELSE '1.5e-7' END, ',\"peak_memory_bytes\":1048576}}') AS line FROM s",
)
def encode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary line for each of forty seeds; one in four was cut off by time."""
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("host")).agg(F.count("*").alias("n"))
    n, host = F.col("n"), F.col("host")
    useful = F.when(host % 2 == 0, 0.0).otherwise(1.5e-7)
    line = summary_line(text("https://h", host, "/?a&b"), host % 4 == 0, n * 1000, text(n, "µs"), {"requests_made": n, "urls_unique": n * 2}, n / 4, useful, F.lit(1048576))
    return rows.select("host", line.alias("line"))


NUMBERS = [
    (0.0, "0"), (1.0, "1"), (-2.5, "-2.5"), (1234567.0, "1234567"), (12345678.9, "12345678.9"), (1e7, "10000000"), (1.5e20, "150000000000000000000"), (1e21, "1e+21"), (-2.25e30, "-2.25e+30"), (0.001, "0.001"),
    (0.00012, "0.00012"), (1e-6, "0.000001"), (9.9e-7, "9.9e-7"), (1e-12, "1e-12"), (100.125, "100.125"), (3.0e10, "30000000000"),
]


@R.add("json_number", " UNION ALL ".join(f"SELECT n_nationkey AS k, {n} AS i, '{shown}' AS shown FROM nation" for n, (_, shown) in enumerate(NUMBERS)))
def json_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = F.posexplode(F.array(*[F.lit(x) for x, _ in NUMBERS])).alias("i", "x")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), cases).select("k", "i", policy.json_number(F.col("x")).alias("shown"))


@R.add("events_jsonl", "SELECT event_id % 10 AS part, count(*) AS lines, sum(strlen(concat('{\"type\":\"page\",\"url\":\"https://h/', event_id, '?a\\u003cb\",\"depth\":0,\"bytes_read\":', event_id % 5000, '}')))::BIGINT AS bytes FROM events GROUP BY 1")
def events_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines written as text and read again: how many, and how long they are."""
    from pagegraph.sources import snapshots
    from pagegraph.storage import fresh_path

    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.lit("page").alias("type"), text("https://h/", e, "?a<b").alias("url"), F.lit(0).alias("depth"), (e % 5000).alias("bytes_read"))
    path = fresh_path(spark, "events-jsonl")
    snapshots.write_events(rows, path)
    back = spark.read.text(path).select((F.regexp_extract("value", "/h/([0-9]+)", 1).cast("long") % 10).alias("part"), F.octet_length("value").cast("long").alias("n"))
    return back.groupBy("part").agg(F.count("*").alias("lines"), F.sum("n").alias("bytes"))


@R.add("fnv_shards", "SELECT page_id, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(strlen(hex(encode(url))) // 2), lambda i: ('0x' || substr(hex(encode(url)), 2 * i::INTEGER + 1, 2))::HUGEINT)), lambda h, b: xor(h::BIGINT, b::BIGINT)::HUGEINT * 16777619 % 4294967296)::BIGINT % 32 AS shard FROM pages")
def fnv_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard, of 32, of each URL in a set that is split by hash."""
    return table(spark, sf_dir, "pages").select("page_id", (policy.fnv1a(F.col("url")) % 32).alias("shard"))


@R.add("duration_cut", "WITH e AS (SELECT user_id % 50 AS run, ts, value FROM events), b AS (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run) AS since FROM e) SELECT run, count(*) FILTER (since <= 864000000000) AS pages, bool_or(since > 864000000000) AS partial FROM b GROUP BY run")
def duration_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that are ended ten days after their start: the pages they got to, and whether they are partial."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    began = rows.groupBy("run").agg(F.min("at").alias("began"))
    late = F.col("at") - F.col("began") > 864000000000
    return rows.join(began, "run").groupBy("run").agg(F.count_if(~late).alias("pages"), F.bool_or(late).alias("partial"))


@R.add(
    "concurrency_sweep",
    "WITH s AS (SELECT [1, 2, 4, 8][l_linenumber % 4 + 1] AS workers, CAST(floor(l_extendedprice) AS BIGINT) AS d FROM lineitem), m AS (SELECT workers, count(*) AS runs, quantile_disc(d, 0.5) AS median, count(*)::DOUBLE * 1000 / sum(d)::DOUBLE AS rate FROM s GROUP BY 1) "
    "SELECT m.workers::INTEGER AS workers, m.runs, m.median, round(m.rate / b.rate, 6) AS speedup FROM m, (SELECT rate FROM m WHERE workers = 1) b",
)
def concurrency_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured runs by their number of workers: median time, and rate against one worker."""
    from pagegraph.operators.stats import nearest_rank

    workers = F.get(F.array(*[F.lit(k) for k in (1, 2, 4, 8)]), F.col("l_linenumber") % 4)
    rows = table(spark, sf_dir, "lineitem").select(workers.alias("workers"), F.floor("l_extendedprice").cast("bigint").alias("d"))
    m = rows.groupBy("workers").agg(F.count("*").alias("runs"), nearest_rank("d", 0.5).alias("median"), (F.count("*") * 1000.0 / F.sum("d")).alias("rate"))
    base = m.where("workers = 1").select(F.col("rate").alias("base"))
    return m.join(F.broadcast(base)).select("workers", "runs", "median", F.round(F.col("rate") / F.col("base"), 6).alias("speedup"))  # base is one row


@R.add("run_samples", "WITH k AS (SELECT event_type AS workload, event_id AS run, CAST(floor(value * 1000) AS BIGINT) AS d, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) SELECT workload, run, d FROM k WHERE n > 5 AND n <= 35")
def run_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty measured runs of each workload after five warm-ups."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("workload"), F.col("event_id").alias("run"), "ts", F.floor(F.col("value") * 1000).cast("bigint").alias("d"))
    n = F.row_number().over(Window.partitionBy("workload").orderBy("ts", "run"))
    return rows.withColumn("n", n).where("n <= 35").where("n > 5").select("workload", "run", "d")


# Reports as lines of a table, from the statistics of repeated runs.
def shown_time(ns: Column) -> Column:
    return F.when(ns < 1_000_000, text(F.floor(ns / 1000), "µs")).otherwise(text(F.floor(ns / 1_000_000), "ms"))


SHOWN = "CASE WHEN {0} < 1000000 THEN concat({0} // 1000, 'µs') ELSE concat({0} // 1000000, 'ms') END"
RUNS = "r AS (SELECT event_type AS workload, CAST(floor(value * 100000) AS BIGINT) AS d, event_id % 11 <> 0 AS passed FROM events)"


@R.add(
    "report_stats",
    f"WITH {RUNS}, s AS (SELECT workload, count(*) AS n, count(*) FILTER (passed) AS p, quantile_disc(d, 0.5) AS med, quantile_disc(d, 0.95) AS p95, quantile_disc(d, 0.99) AS p99 FROM r GROUP BY 1) "
    f"SELECT workload, concat('| ', workload, ' | ', n, ' | ', {SHOWN.format('med')}, ' | ', {SHOWN.format('p95')}, ' | ', {SHOWN.format('p99')}, ' | ', p, '/', n, ' | ', CASE WHEN p = n THEN 'PASS' WHEN p = 0 THEN 'FAIL' ELSE 'FLAKY' END, ' |') AS line FROM s",
)
def report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each workload: runs, median, p95 and p99 of the time, correct runs, verdict."""
    from pagegraph.operators.stats import nearest_rank

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("workload"), F.floor(F.col("value") * 100000).cast("bigint").alias("d"), (F.col("event_id") % 11 != 0).alias("passed"))
    s = rows.groupBy("workload").agg(F.count("*").alias("n"), F.count_if("passed").alias("p"), *[nearest_rank("d", q).alias(name) for name, q in (("med", 0.5), ("p95", 0.95), ("p99", 0.99))])
    verdict = F.when(F.col("p") == F.col("n"), "PASS").when(F.col("p") == 0, "FAIL").otherwise("FLAKY")
    times = [shown_time(F.col(c)) for c in ("med", "p95", "p99")]
    return s.select("workload", text("| ", F.col("workload"), " | ", F.col("n"), " | ", times[0], " | ", times[1], " | ", times[2], " | ", F.col("p"), "/", F.col("n"), " | ", verdict, " |").alias("line"))


@R.add(
    "report_compare",
    f"WITH {q_stats.TOOL}, c AS (SELECT workload, tool, max(found) AS found, max(total) AS total, bool_and(passed) AS fine, max(run) % 997 AS ms, sum(CASE WHEN found > 49 THEN 1 ELSE 0 END)::BIGINT AS extra FROM t GROUP BY 1, 2) "
    "SELECT workload, tool, CASE WHEN tool = 3 THEN concat('| t', tool, ' | — | — | — | not installed |') ELSE concat('| t', tool, ' | ', found, ' / ', total, ' | ', found * 100 // total, '% | ', extra, ' | ', ms, 'ms', CASE WHEN fine THEN '' ELSE ' (nonzero exit)' END, ' |') END AS line FROM c",
)
def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each workload and tool: what it found, its recall, extras and time; a tool that is not there has dashes."""
    c = q_stats.tool_rows(spark, sf_dir).groupBy("workload", "tool").agg(F.max("found").alias("found"), F.max("total").alias("total"), F.bool_and("passed").alias("fine"), (F.max("run") % 997).alias("ms"), F.count_if(F.col("found") > 49).alias("extra"))
    recall = F.floor(F.col("found") * 100 / F.col("total"))
    line = text("| t", F.col("tool"), " | ", F.col("found"), " / ", F.col("total"), " | ", recall, "% | ", F.col("extra"), " | ", F.col("ms"), "ms", F.when(F.col("fine"), "").otherwise(" (nonzero exit)"), " |")
    return c.select("workload", "tool", F.when(F.col("tool") == 3, text("| t", F.col("tool"), " | — | — | — | not installed |")).otherwise(line).alias("line"))


@R.add(
    "report_scale",
    f"WITH {q_stats.P}, {q_stats.E_}, g AS (SELECT *, lag(value) OVER (PARTITION BY family, excluded ORDER BY scale) AS before FROM e) SELECT family, scale, concat('| ', CASE WHEN scale % 1000 = 0 THEN concat(scale // 1000, 'k') ELSE CAST(scale AS VARCHAR) END, ' | ', "
    "CASE WHEN excluded THEN 'excluded | |' WHEN before IS NULL THEN concat(value, ' | |') ELSE concat(value, ' | ', printf('%.2f', value / before), 'x |') END) AS line FROM g",
)
def report_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each scale of a family: its value and the growth since the measured point before, or that it is excluded."""
    from pyspark.sql import Window

    g = q_stats.points(spark, sf_dir).withColumn("before", F.lag("value").over(Window.partitionBy("family", "excluded").orderBy("scale")))
    grown = text(F.col("value"), " | ", F.format_string("%.2f", F.col("value") / F.col("before")), "x |")
    shown = F.when(F.col("excluded"), "excluded | |").when(F.col("before").isNull(), text(F.col("value"), " | |")).otherwise(grown)
    return g.select("family", "scale", text("| ", policy.scale_label(F.col("scale")), " | ", shown).alias("line"))


QUERIES, ORACLES = R.queries, R.oracles
