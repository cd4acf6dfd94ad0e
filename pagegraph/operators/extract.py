"""Discoveries in scripts, markup and side files, as column expressions over page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegraph.functions.urls import join_origin, resolve

#: Fixed patterns of endpoints in scripts.
TEMPLATE = "(?i)\\b(get|post|put|patch|delete)\\s*\\(\\s*`([^`]*/(?:rest|api)/[^`]*)`"
STATIC = "(?:\\b(?i:(get|post|put|patch|delete))\\s*\\(\\s*)?[\"'](/(?:rest|api)/[A-Za-z0-9/_\\-?=&%]+)[\"']"
ASSIGNED = "(?:this\\.)?(\\w+)\\s*=\\s*[^;]+?[\"'](/(?:rest|api)/[A-Za-z0-9/_\\-]+)[\"']"
APPENDED = "(?i)\\b(get|post|put|patch|delete)\\s*\\(\\s*(?:this\\.)?(\\w+)\\s*\\+\\s*[\"']([/A-Za-z0-9_\\-]+)[\"']"
CHUNK = "\\b(chunk-[A-Za-z0-9_\\-]+\\.js)\\b"
SOCKET = "new\\s+WebSocket\\s*\\(\\s*[\"'`](wss?://[^\"'`\\s)]+)[\"'`]"
SOCKET_LITERAL = "[\"'`](wss?://[^\"'`\\s)]{4,})[\"'`]"
SOCKET_PATH = "new\\s+WebSocket\\s*\\(\\s*[\"'`](/[^\"'`\\s)]+)[\"'`]"
MAP_COMMENT = "//[#@]\\s*sourceMappingURL=(\\S+)"
NOISE = "node_modules/|webpack/runtime|__webpack_require__|\\.spec\\.[jt]s$|\\.test\\.[jt]s$|/vendor/"
SPEC_URL = "[\"']((?:https?://[^\"']+)?/[^\"']*(?:openapi|swagger)[^\"']*\\.(?:json|yaml))[\"']"
CODE_PATH = "^(/(?:[A-Za-z0-9_\\-]+/){2,}(?:[A-Za-z0-9_\\-]+|\\{[^}]+\\}|:[A-Za-z][A-Za-z0-9_]*)(?:\\?[^\\s\"'<>]*)?)"
SITEMAP_LINE = "(?i)^\\s*sitemap\\s*:\\s*(https?://\\S+)"


def groups(text: Column, pattern: str, *numbers: int) -> Column:
    """array<struct<g1,g2,..>> of the groups of all matches."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(n)).alias(f"g{n}") for n in numbers]
    return F.arrays_zip(*parts)


def filled(template: Column, origin: Column) -> Column:
    """A template literal with its placeholders filled: hosts first, then numbers, then words."""
    out = F.regexp_replace(template, "\\$\\{[^}]*(?i:host|server|url|base|origin)[^}]*\\}", "\ue000")
    out = F.regexp_replace(out, "\\$\\{[^}]*(?i:id|num|page|limit|offset|count)[^}]*\\}", "1")
    return F.replace(F.regexp_replace(out, "\\$\\{[^}]*\\}", "test"), F.lit("\ue000"), origin)


def endpoint(method: Column, url: Column) -> Column:
    return F.struct(F.when(method == "", "GET").otherwise(F.upper(method)).alias("method"), url.alias("url"))


def template_endpoints(source: Column, origin: Column) -> Column:
    return F.transform(groups(source, TEMPLATE, 1, 2), lambda m: endpoint(m["g1"], join_origin(origin, filled(m["g2"], origin))))


def static_endpoints(source: Column, origin: Column) -> Column:
    """Quoted paths, each followed by its /1 where the last segment is a word and there is no query."""

    def both(m: Column) -> Column:
        url = F.concat(origin, m["g2"])
        probe = ~m["g2"].contains("?") & F.regexp_replace(m["g2"], "/+$", "").rlike("/[A-Za-z]+$")
        return F.when(probe, F.array(endpoint(m["g1"], url), endpoint(m["g1"], F.concat(url, F.lit("/1"))))).otherwise(F.array(endpoint(m["g1"], url)))

    return F.flatten(F.transform(groups(source, STATIC, 1, 2), both))


def indirect_endpoints(source: Column, origin: Column) -> Column:
    """verb(variable + 'suffix') with the last path that was assigned to the variable."""
    bases = groups(source, ASSIGNED, 1, 2)

    def one(m: Column) -> Column:
        base = F.element_at(F.filter(bases, lambda b: b["g1"] == m["g2"]), -1)["g2"]
        return endpoint(m["g1"], F.concat(origin, F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(m["g3"], "^/+", "")))

    return F.filter(F.transform(F.filter(groups(source, APPENDED, 1, 2, 3), lambda m: F.exists(bases, lambda b: b["g1"] == m["g2"])), one), lambda e: e["url"].isNotNull())


def endpoints(source: Column, origin: Column) -> Column:
    """All endpoints of a script, first occurrence of each method and URL, in order of kind."""
    return F.array_distinct(F.concat(template_endpoints(source, origin), static_endpoints(source, origin), indirect_endpoints(source, origin)))


def chunks(source: Column, base: Column) -> Column:
    return F.transform(F.regexp_extract_all(source, F.lit(CHUNK), F.lit(1)), lambda c: resolve(base, c))


def sockets(source: Column, origin: Column) -> Column:
    """Web-socket URLs; sources without a trace of one are not searched."""
    found = F.concat(F.regexp_extract_all(source, F.lit(SOCKET), F.lit(1)), F.regexp_extract_all(source, F.lit(SOCKET_LITERAL), F.lit(1)), F.transform(F.regexp_extract_all(source, F.lit(SOCKET_PATH), F.lit(1)), lambda p: F.concat(F.regexp_replace(origin, "^http", "ws"), p)))
    return F.when(source.contains("WebSocket") | source.contains("ws://") | source.contains("wss://"), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def map_url(source: Column) -> Column:
    """What the last sourceMappingURL comment of the end of a script names; '' if none."""
    window = F.decode(F.substring(F.encode(source, "utf-8"), -4096, 4096), "utf-8")
    return F.coalesce(F.element_at(F.regexp_extract_all(window, F.lit(MAP_COMMENT), F.lit(1)), -1), F.lit(""))


def inline_map(url: Column) -> Column:
    """The text of a base64 data URI; null for other URLs."""
    return F.when(url.rlike("^data:[^,]*;base64,"), F.decode(F.try_to_binary(F.regexp_extract(url, "^data:[^,]*,(.*)$", 1), F.lit("base64")), "utf-8"))


def map_sources(text: Column) -> Column:
    """array<struct<path,content>> of a source map: root in front, noise left out."""
    tree = F.from_json(text, "struct<sources:array<string>,sourcesContent:array<string>,sourceRoot:string>")
    root = F.coalesce(tree["sourceRoot"], F.lit(""))
    prefix = F.when((root == "") | root.endswith("/"), root).otherwise(F.concat(root, F.lit("/")))
    pairs = F.arrays_zip(tree["sources"].alias("path"), tree["sourcesContent"].alias("content"))
    rooted = F.transform(F.filter(pairs, lambda p: p["path"].isNotNull()), lambda p: F.struct(F.concat(prefix, p["path"]).alias("path"), p["content"].alias("content")))
    return F.filter(rooted, lambda p: ~p["path"].rlike(NOISE))


def code_path(text: Column) -> Column:
    """The text of a code element if it looks like an API path, else ''."""
    trimmed = F.btrim(text)
    return F.when(F.regexp_extract(trimmed, "^([^? ]*)", 1).rlike(CODE_PATH + "$"), trimmed).otherwise("")
