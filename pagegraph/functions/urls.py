"""URL functions as column expressions: split, canonicalise, resolve, scope keys.

No Python runs. A URL is cut by the generic-syntax pattern rather than by parse_url, which rejects what
crawled pages hold. It is cut once: what is used more than once is the argument of a lambda, so that an
expression grows with its parts and not with their product.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority with its slashes, path, query with its mark, fragment with its mark.
PARTS = "(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\\?[^#]*)?(#.*)?$"
#: Characters a path keeps when it is written from its decoded form, beside letters, digits and -_.~ .
KEPT = "$&+,/:;=@"


@dataclass
class Url:
    scheme: Column
    authority: Column  # with // in front, or ''
    path: Column
    query: Column  # with ? in front, or ''
    fragment: Column

    @property
    def host(self) -> Column:
        """Host and port, without user information."""
        return F.regexp_replace(self.authority, "^//(?:[^@]*@)?", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_url(url: Column) -> Url:
    """The parts of a URL, each found on its own: for expressions that use one or two of them."""
    part = lambda k: F.regexp_extract(url, PARTS, k)
    return Url(F.lower(part(1)), part(2), part(3), part(4), part(5))


def with_parts(url: Column, body: Callable[[Url], Column]) -> Column:
    """body of the parts of a URL, which is cut once."""
    cut = F.split(F.regexp_replace(url, PARTS, "$1\0$2\0$3\0$4\0$5"), "\0", -1)
    return let(cut, lambda p: body(Url(F.lower(F.get(p, 0)), *[F.get(p, k) for k in range(1, 5)])))


def encode_path(path: Column) -> Column:
    """Percent-encodes a decoded path."""
    out = F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for c in KEPT + "~":
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def decode_path(path: Column) -> Column:
    """The decoded path; null where an escape is broken."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def parsable(url: Column, u: Url, host: Column) -> Column:
    """False for control characters, broken escapes before the query, and ports that are not numbers."""
    bad = url.rlike("[\\x00-\\x1F\\x7F]") | F.concat(u.authority, u.path).rlike("%(?![0-9A-Fa-f]{2})") | host.rlike("(:[^:\\]]*[^0-9:\\]][^:\\]]*$| )") | url.startswith(":")
    return ~bad


def strip_default_port(scheme: Column, host: Column) -> Column:
    """The host without :80 of http or :443 of https."""
    return F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)


def form_escape(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))


def query_pairs(query: Column) -> Column:
    """array<struct<k,v>> of decoded pairs of a query without its mark; empty parts are left out."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    plain = lambda s: F.try_url_decode(s)
    return F.transform(parts, lambda p: F.struct(plain(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"), plain(F.regexp_extract(p, "(?s)^[^=]*=?(.*)$", 1)).alias("v")))


def sorted_query(query: Column) -> Column:
    """The query with keys and then values in order, escaped anew; as it was if a part is broken."""
    pairs = query_pairs(query)
    broken = query.contains(";") | F.exists(pairs, lambda p: p["k"].isNull() | p["v"].isNull())
    made = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(form_escape(p["k"]), F.lit("="), form_escape(p["v"]))), "&")
    return F.when(broken, query).otherwise(made)


def canonicalize(url: Column, strict: bool = True, sort_query: bool = False) -> Column:
    """One spelling for a URL: lower-case scheme and host, no default port (strict), decoded and re-encoded
    path without trailing slashes, no fragment, no bare question mark. What can't be parsed stays."""

    def made(u: Url, host: Column, raw: Column) -> Column:
        user = F.regexp_extract(u.authority, "^//([^@]*@)", 1)
        name = strip_default_port(u.scheme, F.lower(host)) if strict else F.lower(host)
        path = let(F.rtrim(raw, F.lit("/")), lambda x: F.when(x == "", F.lit("/")).otherwise(encode_path(x)))
        query = F.when(u.query == "?", "").otherwise(u.query)
        if sort_query:
            query = F.when(query == "", query).otherwise(F.concat(F.lit("?"), sorted_query(F.substring(query, 2, 2**30))))
        scheme = F.when(u.scheme == "", "").otherwise(F.concat(u.scheme, F.lit(":")))
        opaque = (u.scheme != "") & (u.authority == "") & ~u.path.startswith("/")
        whole = F.concat(scheme, F.when(u.authority == "", "").otherwise(F.concat(F.lit("//"), user, name)), path, query)
        return F.when(~parsable(url, u, host) | raw.isNull(), url).when(opaque, F.concat(scheme, u.path, query)).otherwise(whole)

    return with_parts(url, lambda u: let(u.host, lambda host: let(decode_path(u.path), lambda raw: made(u, host, raw))))


def without_dots(path: Column) -> Column:
    """The path without . and .. segments."""

    def step(a: Column, s: Column) -> Column:
        up = F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
        return F.when(s == ".", a).when(s == "..", up).otherwise(F.concat(a, F.array(s)))

    def made(parts: Column) -> Column:
        kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
        out = F.array_join(F.concat(kept, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")
        return F.concat(F.when(out.startswith("/"), "").otherwise("/"), out)

    return let(path, lambda x: F.when(x.rlike("(^|/)\\.\\.?(/|$)"), let(F.split(x, "/"), made)).otherwise(x))


def written_path(path: Column) -> Column:
    """A path as it is serialised: as it stands if all its characters may, else decoded and encoded."""
    return let(path, lambda x: F.when(x.rlike("^[A-Za-z0-9._~!$&'()*+,;=:@%/\\[\\]-]*$"), x).otherwise(encode_path(decode_path(x))))


def resolve(base: Column, ref: Column) -> Column:
    """ref against base by the generic-syntax rules, without fragment."""

    def made(b: Url, r: Url) -> Column:
        merged = F.concat(F.when((b.authority != "") & (b.path == ""), F.lit("/")).otherwise(F.regexp_replace(b.path, "[^/]*$", "")), r.path)
        own = (r.scheme != "") | (r.authority != "")
        scheme = F.when(r.scheme != "", r.scheme).otherwise(b.scheme)
        authority = F.when(own, r.authority).otherwise(b.authority)
        path = F.when(~own & (r.path == ""), b.path).otherwise(without_dots(F.when(own | r.path.startswith("/"), r.path).otherwise(merged)))
        query = F.when(own | (r.path != "") | (r.query != ""), r.query).otherwise(b.query)
        opaque = (r.scheme != "") & (r.authority == "") & ~r.path.startswith("/")
        whole = F.concat(scheme, F.when(scheme == "", "").otherwise(F.lit(":")), authority, written_path(path), query)
        return F.when(opaque, F.concat(r.scheme, F.lit(":"), r.path, r.query)).otherwise(whole)

    return with_parts(base, lambda b: with_parts(ref, lambda r: made(b, r)))


def skippable(href: Column) -> Column:
    """Links that lead nowhere; the prefixes are case-sensitive."""
    return href.startswith("javascript:") | href.startswith("mailto:") | href.startswith("#")


def strip_port(host: Column) -> Column:
    return F.regexp_replace(host, ":[^:]*$", "")


def origin(url: Column) -> Column:
    return with_parts(url, lambda u: F.concat(u.scheme, F.lit("://"), u.host))


def query_key_count(url: Column) -> Column:
    """Different keys of the query; broken pairs and pairs with ; are left out."""
    query = F.regexp_replace(split_url(url).query, "^\\?", "")
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.contains(";"))
    keys = F.transform(parts, lambda p: F.try_url_decode(F.regexp_extract(p, "(?s)^([^=]*)", 1)))
    return F.size(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))


def join_origin(base_origin: Column, target: Column) -> Column:
    return F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("/"), F.concat(base_origin, target)).otherwise(F.concat(base_origin, F.lit("/"), target))


def meta_refresh_url(content: Column) -> Column:
    """The target of a refresh: after the first ; a url= in any case, without blanks and quotes; '' if none."""
    found = F.regexp_extract(content, "(?s)^[^;]*;\\s*(?i:url)\\s*=\\s*(.*)$", 1)
    return F.btrim(F.btrim(found), F.lit("\"'"))


#: Extensions of files that are fetched without rendering.
ASSETS = ["js", "mjs", "css", "json", "map", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp", "woff", "woff2", "ttf", "eot", "otf", "pdf", "zip", "gz", "tar", "mp3", "mp4", "webm", "ogg", "wav", "xml", "txt", "csv"]


def is_asset(url: Column) -> Column:
    return F.lower(F.regexp_extract(split_url(url).path, "\\.([^./]*)$", 1)).isin(*ASSETS)
