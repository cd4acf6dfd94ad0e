"""Queries over what pages and their side files hold: scripts, markup, robots, sitemaps, source maps, events.

The markup that the test tables lack is built from their keys, alike in the query and in its twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.functions import policy, urls
from pagegraph.operators import extract, html, robots
from pagegraph.registry import Registry, dealt, table

R = Registry()
TOP = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
FOLDER = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '')"


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    body = text("this.http.get(`${this.host}/rest/p", i, "/search?q=${term}&page=${pageNo}`); axios.delete(\"/api/items/", i, "\"); fetch(\"/rest/orders\"); fetch(\"/api/x.css\"); this.host = base + \"/rest/user\"; this.http.post(this.host + \"/login\", body); import(\"./chunk-a", i, ".js\"); new WebSocket(\"wss://w", i, ".example/x\"); new WebSocket('/ws/chat');\n//# sourceMappingURL=app", i, ".js.map\n")
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.origin(F.col("url")).alias("origin"), body.alias("body"))


def expected(*rows: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT page_id, '{m}' AS method, concat({TOP}, {u}) AS url FROM pages" for m, u in rows)


TEMPLATES = [("GET", "'/rest/p', page_id, '/search?q=test&page=1'")]
STATICS = [("DELETE", "'/api/items/', page_id"), ("GET", "'/rest/orders'"), ("GET", "'/rest/orders/1'"), ("GET", "'/rest/user'"), ("GET", "'/rest/user/1'")]
INDIRECT = [("POST", "'/rest/user/login'")]


def _exploded(kind):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scripts(spark, sf_dir).select("page_id", F.inline(kind(F.col("body"), F.col("origin"))))

    return query


R.add("js_template", expected(*TEMPLATES))(_exploded(extract.template_endpoints))
R.add("js_static", expected(*STATICS))(_exploded(extract.static_endpoints))
R.add("js_indirect", expected(*INDIRECT))(_exploded(extract.indirect_endpoints))
R.add("js_endpoints", expected(*TEMPLATES, *STATICS, *INDIRECT))(_exploded(extract.endpoints))


@R.add("js_template_subst", f"SELECT page_id, concat({TOP}, '/api/', '1', '/', 'test') AS filled FROM pages")
def js_template_subst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts(spark, sf_dir).select("page_id", extract.filled(F.lit("${baseUrl}/api/${itemId}/${name}"), F.col("origin")).alias("filled"))


@R.add("js_infer_method", f"SELECT method, count(*) AS n FROM ({expected(*STATICS)}) GROUP BY method")
def js_infer_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(extract.static_endpoints)(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n"))


@R.add("js_probe_variant", f"SELECT page_id, url FROM ({expected(*STATICS)}) WHERE url LIKE '%/orders/1' OR url LIKE '%/user/1'")
def js_probe_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(extract.static_endpoints)(spark, sf_dir).where("url like '%/orders/1' or url like '%/user/1'").select("page_id", "url")


@R.add("js_chunks", f"SELECT page_id, concat({FOLDER}, 'chunk-a', page_id, '.js') AS chunk FROM pages")
def js_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts(spark, sf_dir).select("page_id", F.explode(extract.chunks(F.col("body"), F.col("url"))).alias("chunk"))


@R.add("websockets", f"SELECT page_id, concat('wss://w', page_id, '.example/x') AS socket FROM pages UNION ALL SELECT page_id, concat(regexp_replace({TOP}, '^http', 'ws'), '/ws/chat') FROM pages")
def websockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts(spark, sf_dir).select("page_id", F.explode(extract.sockets(F.col("body"), F.col("origin"))).alias("socket"))


@R.add("sourcemap_locate", f"SELECT page_id, concat({FOLDER}, 'app', page_id, '.js.map') AS map FROM pages")
def sourcemap_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts(spark, sf_dir).select("page_id", urls.resolve(F.col("url"), extract.map_url(F.col("body"))).alias("map"))


@R.add("sourcemap_inline", "SELECT page_id, concat('{\"version\":3,\"sources\":[\"a', page_id, '.ts\"]}') AS map FROM pages")
def sourcemap_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = text('{"version":3,"sources":["a', F.col("page_id"), '.ts"]}')
    uri = F.concat(F.lit("data:application/json;base64,"), F.base64(F.encode(plain, "utf-8")))
    return table(spark, sf_dir, "pages").select("page_id", extract.inline_map(uri).alias("map"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    body = text('{"version":3,"sourceRoot":"/src","sources":["a', i, '.ts","node_modules/x.js","b.spec.ts","c', i, '.ts"],"sourcesContent":["let a","x","y",null]}')
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("map"))


@R.add("sourcemap_parse", "SELECT doc_id, concat('/src/a', doc_id, '.ts') AS path, 'let a' AS content FROM documents UNION ALL SELECT doc_id, concat('/src/c', doc_id, '.ts'), NULL FROM documents")
def sourcemap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps(spark, sf_dir).select("doc_id", F.inline(extract.map_sources(F.col("map"))))


@R.add("source_map_discovery", "SELECT doc_id, 1::BIGINT AS sources, 2::BIGINT AS mapping FROM documents")
def source_map_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maps(spark, sf_dir).select("doc_id", extract.map_sources(F.col("map")).alias("s"))
    return found.select("doc_id", F.size(F.filter("s", lambda p: F.coalesce(p["content"], F.lit("")) != "")).cast("long").alias("sources"), F.size("s").cast("long").alias("mapping")).where("sources > 0")


@R.add("sourcemap_noise", f"SELECT p_partkey AS k, NOT regexp_matches(path, '{extract.NOISE}') AS kept FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'node_modules/x' WHEN 1 THEN 'src/a.ts' WHEN 2 THEN 'a.test.js' WHEN 3 THEN 'x/vendor/y' ELSE 'webpack/app' END AS path FROM part)")
def sourcemap_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") % 5
    path = F.when(s == 0, "node_modules/x").when(s == 1, "src/a.ts").when(s == 2, "a.test.js").when(s == 3, "x/vendor/y").otherwise("webpack/app")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (~path.rlike(extract.NOISE)).alias("kept"))


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of pages, by key: two that hold everything, in other spellings and with other fields, and one with a link only."""
    i = F.col("c_custkey")
    first = text(
        "<html><head><base href='/root/'><base href='/no/'><link href='/s.css'><meta http-equiv=Refresh content=\"0; URL='/next'\"></head><body data-url='{x}'><noscript><a href='/hidden'>h</a></noscript>",
        "<a href='/c", i, "?a=1&amp;b=2'>x</a><a href='mailto:x@y'>m</a><a href='#top'>t</a><img src='/i", i, ".png'><iframe src='/f'></iframe><button formaction='/b'>b</button><div data-href='/settings'></div><script src='/app.js'></script>",
        "<code>/api/v1/{id}</code><code>GET /a/b</code><form action='/login' method=post><input type=hidden name=csrf value=t", i, "><input type=email name=mail required><input name=nick><input type=button name=no><select name=col><option value=s><option value=blue selected></select><textarea name=note required>zz</textarea><input type=submit name=go value=1></form>",
        "<form action='/none'><input type=hidden name=h></form>",
    )
    second = text(
        "<!DOCTYPE html><HTML><BASE HREF=\"\"><Base\thref = /other/ ><!-- <a href='/no'> --><META CONTENT='5 ; url=/next' HTTP-EQUIV=REFRESH><LINK rel=x HREF=/s.css><SCRIPT SRC=\"/app.js\">var a = \"<a href='/no'>\";</SCRIPT>",
        "<A title='>' HREF=\"/no\" href='/c", i, "?a=1&#38;b=2'>x<A HREF=javascript:x()>n</A><IMG SRC=/i", i, ".png><IFRAME src='/f'><a href='/no'></IFRAME><BUTTON formAction=/b>b</BUTTON><P data-HREF='/settings'>",
        "<style>a { href: '<a href=/no>' }</style><CODE> /api/v2/x </CODE><FORM ACTION='/find?q=1'><INPUT NAME=n TYPE=Number REQUIRED><input name=q value='v&amp;w'><select name=s><option><option value=one><option value=two></select><INPUT TYPE=Hidden NAME=csrf VALUE=c", i, "></FORM>",
    )
    page = F.when(i % 3 == 0, first).when(i % 3 == 1, second).otherwise(text("<p><a href='/only", i, "'>y</a><form></form>"))
    return dealt(spark, sf_dir, "customer", "c_custkey").select(i.alias("page_id"), page.alias("html"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.discoveries(markup(spark, sf_dir))


def _links(source: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return found(spark, sf_dir).where(F.col("source") == source).select("page_id", F.col("value").alias("href"))

    return query


for _name, _source, _href in (
    ("links_anchor", "a_href", "concat('/c', c_custkey, '?a=1&b=2')"), ("links_link", "link_href", "'/s.css'"), ("links_script", "script_src", "'/app.js'"), ("links_img", "img_src", "concat('/i', c_custkey, '.png')"),
    ("links_iframe", "iframe_src", "'/f'"), ("links_button", "button_formaction", "'/b'"), ("links_meta_refresh", "meta_refresh", "'/next'"), ("data_attr_links", "data-href", "'/settings'"), ("base_href", "base", "CASE c_custkey % 3 WHEN 0 THEN '/root/' ELSE '/other/' END"),
):
    _rest = "UNION ALL SELECT c_custkey, concat('/only', c_custkey) FROM customer WHERE c_custkey % 3 = 2" if _source == "a_href" else ""
    R.add(_name, f"SELECT c_custkey AS page_id, {_href} AS href FROM customer WHERE c_custkey % 3 < 2 {_rest}")(_links(_source))


PLAIN = "regexp_replace(html, '<!--.*?-->|(<script)([^>]*>).*?</script>|<style.*?</style>|<title.*?</title>|<textarea.*?</textarea>|<iframe([^>]*>).*?</iframe>', '\\1\\2', 'gs')"
SEEN = {"a_href": "<a\\s[^>]*\\bhref=\"[^\"]+\"", "script_src": "<script\\s[^>]*\\bsrc=\"[^\"]+\"", "img_src": "<img\\s[^>]*\\bsrc=\"[^\"]+\"", "link_href": "<link\\s[^>]*\\bhref=\"[^\"]+\""}
SEEN_SQL = " UNION ALL ".join(f"SELECT page_id, 'link' AS kind, '{source}' AS source, len(regexp_extract_all(plain, '{pattern}')) AS n FROM p" for source, pattern in SEEN.items())


@R.add("html_tokens", f"WITH p AS (SELECT page_id, {PLAIN} AS plain FROM pages) SELECT * FROM ({SEEN_SQL}) WHERE n > 0")
def html_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discoveries of the page snapshots themselves."""
    return html.discoveries(table(spark, sf_dir, "pages")).groupBy("page_id", "kind", "source").agg(F.count("*").alias("n"))


@R.add("code_paths", "SELECT c_custkey AS page_id, CASE c_custkey % 3 WHEN 0 THEN '/api/v1/{id}' ELSE '/api/v2/x' END AS path FROM customer WHERE c_custkey % 3 < 2")
def code_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).where("kind = 'code'").select("page_id", extract.code_path(F.col("value")).alias("path")).where("path <> ''")


@R.add("forms", "SELECT c_custkey AS page_id, '/login' AS action, 'POST' AS method, 4 AS n_params, 2 AS n_base FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, '/find?q=1', 'GET', 3, 1 FROM customer WHERE c_custkey % 3 = 1")
def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).where("kind = 'form'").select("page_id", F.col("value").alias("action"), "method", F.size("params").alias("n_params"), F.size("base").alias("n_base"))


@R.add("form_params", "SELECT c_custkey AS page_id, unnest(['col', 'mail', 'nick', 'note']) AS name, unnest(['blue', 'test@example.com', '', 'test']) AS value FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, unnest(['n', 'q', 's']), unnest(['1', 'v&w', 'one']) FROM customer WHERE c_custkey % 3 = 1")
def form_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).where("kind = 'form'").select("page_id", F.inline("params"))


@R.add("form_select", "SELECT c_custkey AS page_id, CASE c_custkey % 3 WHEN 0 THEN 'blue' ELSE 'one' END AS value FROM customer WHERE c_custkey % 3 < 2")
def form_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_params(spark, sf_dir).where("name in ('col', 's')").select("page_id", "value")


@R.add("form_textarea", "SELECT c_custkey AS page_id, 'test' AS value FROM customer WHERE c_custkey % 3 = 0")
def form_textarea(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_params(spark, sf_dir).where("name = 'note'").select("page_id", "value")


@R.add("form_drop_empty", "SELECT count(*) AS forms FROM customer WHERE c_custkey % 3 < 2")
def form_drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms without a field to fill are left out."""
    return found(spark, sf_dir).where("kind = 'form'").agg(F.count("*").alias("forms"))


@R.add("login_form", "SELECT c_custkey AS page_id, CASE c_custkey % 3 WHEN 0 THEN '/login' ELSE '/find?q=1' END AS action, concat(CASE c_custkey % 3 WHEN 0 THEN 't' ELSE 'c' END, c_custkey) AS csrf FROM customer WHERE c_custkey % 3 < 2")
def login_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first form of a page and its hidden fields."""
    first = found(spark, sf_dir).where("kind = 'form'").groupBy("page_id").agg(F.min_by(F.struct("value", "base"), "ord").alias("f"))
    return first.select("page_id", F.col("f.value").alias("action"), F.filter("f.base", lambda b: b["name"] == "csrf")[0]["value"].alias("csrf"))


@R.add(
    "discoveries_all",
    "WITH c AS (SELECT count(*) FILTER (c_custkey % 3 = 0) AS a, count(*) FILTER (c_custkey % 3 = 1) AS b, count(*) FILTER (c_custkey % 3 = 2) AS r FROM customer) "
    "SELECT kind, source, x * a + y * b + z * r AS n FROM c, (VALUES ('link', 'a_href', 1, 1, 1), ('link', 'link_href', 1, 1, 0), ('link', 'script_src', 1, 1, 0), ('link', 'img_src', 1, 1, 0), ('link', 'iframe_src', 1, 1, 0), ('link', 'button_formaction', 1, 1, 0), "
    "('link', 'meta_refresh', 1, 1, 0), ('link', 'data-href', 1, 1, 0), ('code', 'code_block', 2, 1, 0), ('form', 'form', 1, 1, 0), ('base', 'base', 1, 1, 0)) v(kind, source, x, y, z)",
)
def discoveries_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).groupBy("kind", "source").agg(F.count("*").alias("n"))


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lower("n_name")
    body = text("﻿# hello\nUser-agent: *\nDisallow: /", n, "\nAllow: /", n, "/public\nCrawl-delay: 3\n\nUser-agent: Bot\nUser-agent: other\nDisallow: /private # c\nDisallow:\nSitemap: https://h", F.col("n_nationkey"), ".example/map.xml\n")
    return table(spark, sf_dir, "nation").select(text("h", F.col("n_nationkey"), ".example").alias("host"), F.lower("n_name").alias("n"), body.alias("body"))


HOST = "concat('h', n_nationkey, '.example')"


@R.add("robots_rules", f"SELECT {HOST} AS host, '*' AS agent, concat('/', lower(n_name)) AS path, false AS allow FROM nation UNION ALL SELECT {HOST}, '*', concat('/', lower(n_name), '/public'), true FROM nation UNION ALL SELECT {HOST}, unnest(['bot', 'other']), '/private', false FROM nation")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.rules(robots_files(spark, sf_dir)).select("host", "agent", "path", "allow")


@R.add("robots_allowed", f"SELECT {HOST} AS host, concat('/', replace(lower(n_name), ' ', '%20'), p) AS path, p LIKE '/p%' AS allowed FROM nation, (SELECT unnest(['', '/x', '/public', '/p%75blic/y']) AS p) UNION ALL SELECT {HOST}, '/other', true FROM nation UNION ALL SELECT {HOST}, '/%zz', true FROM nation")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with escapes, one of them broken, against rules that are written without."""
    files = robots_files(spark, sf_dir)
    ends = F.array(*[F.lit(e) for e in ("", "/x", "/public", "/p%75blic/y")])
    paths = F.concat(F.transform(ends, lambda e: F.concat(F.lit("/"), F.replace("n", F.lit(" "), F.lit("%20")), e)), F.array(F.lit("/other"), F.lit("/%zz")))
    asked = files.select("host", F.explode(paths).alias("path")).withColumn("id", F.xxhash64("host", "path"))
    return robots.allowed(asked, robots.rules(files), "crawler").select("host", "path", "allowed")


@R.add("sitemap_directives", "SELECT concat('h', n_nationkey, '.example') AS host, concat('https://h', n_nationkey, '.example/map.xml') AS sitemap FROM nation")
def sitemap_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = robots_files(spark, sf_dir).select("host", F.explode(F.split("body", "\n")).alias("line"))
    return lines.select("host", F.regexp_extract("line", extract.SITEMAP_LINE, 1).alias("sitemap")).where("sitemap <> ''")


@R.add("sitemap_locs", "SELECT s_suppkey AS k, unnest([concat('https://s.example/', s_suppkey), concat('http://s.example/b', s_suppkey)]) AS loc FROM supplier WHERE s_suppkey % 5 <> 0")
def sitemap_locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute locations of a urlset; documents that are not well formed have none."""
    i = F.col("s_suppkey")
    body = F.when(i % 5 == 0, "<urlset><url>").otherwise(text("<urlset xmlns='x'><url><loc> https://s.example/", i, " </loc></url><url><loc>http://s.example/b", i, "</loc></url><url><loc>/relative</loc></url><url><loc></loc></url></urlset>"))
    tree = F.from_xml(body, "struct<url:array<struct<loc:string>>>", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "supplier").select(i.alias("k"), F.explode(tree["url"]["loc"]).alias("loc")).select("k", F.btrim("loc").alias("loc")).where("loc rlike '^https?://'")


@R.add("openapi_embedded_url", f"SELECT page_id, concat({TOP}, '/docs/openapi', page_id, '.json') AS spec FROM pages")
def openapi_embedded_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = text("SwaggerUIBundle({url: '/docs/openapi", F.col("page_id"), ".json', x: '/a.json'})")
    return table(spark, sf_dir, "pages").select("page_id", urls.resolve(F.col("url"), F.regexp_extract(body, extract.SPEC_URL, 1)).alias("spec"))


@R.add("cookie_header", "SELECT o_custkey AS k, string_agg(concat('c', o_orderkey, '=', o_orderstatus), '; ' ORDER BY o_orderkey) AS cookie FROM orders GROUP BY 1")
def cookie_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("o_orderkey", text("c", F.col("o_orderkey"), "=", F.col("o_orderstatus")).alias("c"))))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_join(F.transform(pairs, lambda x: x["c"]), "; ").alias("cookie"))


@R.add("basic_auth_header", "SELECT c_custkey AS k, concat('Basic ', to_base64(encode(concat(c_name, ':p:', c_custkey)))) AS header FROM customer")
def basic_auth_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), policy.basic_auth(text(F.col("c_name"), ":p:", F.col("c_custkey"))).alias("header"))


@R.add("token_from_json", "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN concat('t', c_custkey) WHEN 1 THEN concat('j', c_custkey) END AS token FROM customer")
def token_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    body = F.when(i % 4 == 0, text('{"jwt": "no", "access_token": "t', i, '"}')).when(i % 4 == 1, text('{"token": "", "jwt": "j', i, '"}')).when(i % 4 == 2, text('{"token": ', i, "}")).otherwise("not json")
    return table(spark, sf_dir, "customer").select(i.alias("k"), policy.token_from_json(body).alias("token"))


def _form(pairs: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(urls.form_escape(p["k"]), F.lit("="), urls.form_escape(p["v"]))), "&")


def _pairs(**values: str | Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(v) if isinstance(v, str) else v.cast("string")).alias("v")) for k, v in values.items()])


@R.add("login_request", "SELECT c_custkey AS k, concat('csrf=t', c_custkey, '&password=p+w%26&username=', replace(url_encode(c_name), '%20', '+')) AS body FROM customer")
def login_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body that a login form would be sent with; nothing is sent."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), _form(_pairs(csrf=text("t", F.col("c_custkey")), username=F.col("c_name"), password="p w&")).alias("body"))


@R.add("bearer_request", "SELECT c_custkey AS k, concat('client_id=', c_custkey, '&client_secret=s%2F', c_custkey, '&grant_type=client_credentials') AS body FROM customer")
def bearer_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), _form(_pairs(grant_type="client_credentials", client_id=F.col("c_custkey"), client_secret=text("s/", F.col("c_custkey")))).alias("body"))


@R.add("extractor_applies", "SELECT k, kind, contains(lower(kind), 'html') AS html, contains(lower(kind), 'javascript') AS script FROM (SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN 'Text/HTML' WHEN 1 THEN 'application/javascript' WHEN 2 THEN 'text/css' ELSE '' END AS kind FROM part)")
def extractor_applies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") % 4
    kind = F.when(s == 0, "Text/HTML").when(s == 1, "application/javascript").when(s == 2, "text/css").otherwise("")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), kind.alias("kind")).select("k", "kind", F.lower("kind").contains("html").alias("html"), F.lower("kind").contains("javascript").alias("script"))


@R.add("scan_pages", "SELECT page_id, url, strlen(html) AS bytes FROM pages")
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.octet_length("html").cast("long").alias("bytes"))


@R.add("fetch_join", "SELECT p.page_id, f.depth, strlen(p.html) AS bytes FROM pages p JOIN (SELECT DISTINCT url, page_id % 4 AS depth FROM pages) f ON f.url = p.url")
def fetch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    frontier = pages.select("url", (F.col("page_id") % 4).alias("depth")).distinct()
    return pages.join(frontier, "url").select("page_id", "depth", F.octet_length("html").cast("long").alias("bytes"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (e % 100).alias("host"), F.when(e % 9 == 0, "error").otherwise("page").alias("type"), F.when(e % 7 == 0, "text/javascript").otherwise("text/html").alias("content_type"), (e % 5000).alias("bytes_read"), (e % 3).alias("redirects"), (e % 4).alias("attempts"))


EV = "e AS (SELECT event_id, event_id % 100 AS host, CASE WHEN event_id % 9 = 0 THEN 'error' ELSE 'page' END AS type, CASE WHEN event_id % 7 = 0 THEN 'text/javascript' ELSE 'text/html' END AS content_type, event_id % 5000 AS bytes_read, event_id % 3 AS redirects, event_id % 4 AS attempts FROM events)"


@R.add("crawl_summary", f"WITH {EV} SELECT count(*) AS requests_made, count(*) FILTER (type = 'page') AS responses_ok, count(*) FILTER (type = 'error') AS responses_failed, sum(redirects)::BIGINT AS redirects_followed, sum(attempts)::BIGINT AS retry_attempts, count(DISTINCT host) AS hosts FROM e")
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).agg(F.count("*").alias("requests_made"), F.count_if(F.col("type") == "page").alias("responses_ok"), F.count_if(F.col("type") == "error").alias("responses_failed"), F.sum("redirects").alias("redirects_followed"), F.sum("attempts").alias("retry_attempts"), F.count_distinct("host").alias("hosts"))


@R.add("summary_rates", f"WITH {EV} SELECT host, round(coalesce(count(*) / nullif(sum(attempts), 0), 0), 6) AS per_second, greatest(0, sum(bytes_read) - sum(redirects) * 1000)::BIGINT AS active FROM e GROUP BY host")
def summary_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy("host").agg(F.count("*").alias("n"), F.sum("attempts").alias("s"), F.sum("bytes_read").alias("b"), F.sum("redirects").alias("r"))
    return rows.select("host", F.round(F.coalesce(F.try_divide("n", "s"), F.lit(0.0)), 6).alias("per_second"), F.greatest(F.lit(0).cast("long"), F.col("b") - F.col("r") * 1000).alias("active"))


@R.add("js_files", f"WITH {EV} SELECT host, count(*) FILTER (contains(content_type, 'javascript')) AS js_files FROM e WHERE type = 'page' GROUP BY host")
def js_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("type = 'page'").groupBy("host").agg(F.count_if(F.col("content_type").contains("javascript")).alias("js_files"))


@R.add("bytes_received", f"WITH {EV} SELECT sum(bytes_read)::BIGINT AS bytes FROM e WHERE type = 'page'")
def bytes_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("type = 'page'").agg(F.sum("bytes_read").alias("bytes"))


@R.add("discovery_counts", "SELECT count(*) AS forms, sum(4 - c_custkey % 3)::BIGINT AS params FROM customer WHERE c_custkey % 3 < 2")
def discovery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).where("kind = 'form'").agg(F.count("*").alias("forms"), F.sum(F.size("params")).alias("params"))


@R.add("encode_page", f"WITH {EV} SELECT event_id, concat('{{\"type\":\"page\",\"url\":\"https://h/', host, '?a\\u003cb\\u0026c\",\"bytes_read\":', bytes_read, CASE WHEN attempts > 0 THEN concat(',\"retry_attempts\":', attempts) ELSE '' END, '}}') AS line FROM e WHERE type = 'page'")
def encode_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines: empty fields are left out, and <, > and & escaped."""
    rows = events(spark, sf_dir).where("type = 'page'")
    body = F.struct("type", text("https://h/", F.col("host"), "?a<b&c").alias("url"), "bytes_read", F.nullif(F.col("attempts"), F.lit(0)).alias("retry_attempts"))
    return rows.select("event_id", policy.html_safe_json(F.to_json(body)).alias("line"))


@R.add("encode_error", f"WITH {EV} SELECT event_id, concat('{{\"type\":\"error\",\"url\":\"https://h/', host, '\",\"stage\":\"fetch\",\"error\":\"http status 500\"}}') AS line FROM e WHERE type = 'error'")
def encode_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("type = 'error'")
    return rows.select("event_id", policy.html_safe_json(F.to_json(F.struct("type", text("https://h/", F.col("host")).alias("url"), F.lit("fetch").alias("stage"), F.lit("http status 500").alias("error")))).alias("line"))


@R.add("json_html_escape", "SELECT page_id, replace(replace(replace(url || '<&>', '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') AS escaped FROM pages")
def json_html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", policy.html_safe_json(text(F.col("url"), "<&>")).alias("escaped"))


@R.add("read_events_jsonl", f"WITH {EV} SELECT host, count(*) AS pages, sum(bytes_read)::BIGINT AS bytes FROM e WHERE type = 'page' GROUP BY host")
def read_events_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and bytes per host from event lines; lines that are no JSON are skipped."""
    lines = encode_page(spark, sf_dir).select("line").union(table(spark, sf_dir, "region").select(F.lit("{broken")))
    parsed = lines.select(F.from_json("line", "struct<type:string,url:string,bytes_read:long>", {"mode": "PERMISSIVE"}).alias("e")).where("e.type = 'page'")
    return parsed.groupBy(F.regexp_extract("e.url", "^https://h/([0-9]+)", 1).cast("long").alias("host")).agg(F.count("*").alias("pages"), F.sum("e.bytes_read").alias("bytes"))


@R.add("human_stream", f"WITH {EV}, k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY event_id) AS k FROM e) SELECT type, CASE WHEN k <= 20 THEN concat('[', type, '] ', event_id) ELSE '...' END AS line FROM k WHERE k <= 21")
def human_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty events of a type, then dots."""
    from pyspark.sql import Window

    k = events(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy("event_id"))).where("k <= 21")
    return k.select("type", F.when(F.col("k") <= 20, text("[", F.col("type"), "] ", F.col("event_id"))).otherwise("...").alias("line"))


QUERIES, ORACLES = R.queries, R.oracles
