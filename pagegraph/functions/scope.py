"""Scope policies as predicates over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegraph.functions.urls import let, split_url, strip_port, with_parts


def host_of(url: Column) -> Column:
    return F.lower(split_url(url).host)


def exact_origin(url: Column, seed: Column) -> Column:
    """Same scheme, host and port, whatever the case; a default port written out is another origin."""
    return with_parts(url, lambda a: with_parts(seed, lambda b: (a.scheme == b.scheme) & (F.lower(a.host) == F.lower(b.host))))


def under(host: Column, root: Column) -> Column:
    return (host == F.lower(root)) | host.endswith(F.concat(F.lit("."), F.lower(root)))


def subdomain(url: Column, root: Column) -> Column:
    """The host is the root domain or under it; ports and schemes do not matter."""
    return let(strip_port(host_of(url)), lambda host: under(host, root))


def allow_deny(url: Column, allow: list[str], deny: list[str]) -> Column:
    """Deny wins; an empty allow list lets everything in; both reach subdomains."""
    some = lambda host, names: reduce(lambda a, b: a | b, [under(host, F.lit(n)) for n in names], F.lit(False))
    return let(strip_port(host_of(url)), lambda host: ~some(host, deny) & (some(host, allow) if allow else F.lit(True)))


def patterns(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclude wins; an empty include list lets everything in; patterns are found anywhere in the URL."""
    hit = lambda ps: reduce(lambda a, b: a | b, [url.rlike(p) for p in ps], F.lit(False))
    return ~hit(exclude) & (hit(include) if include else F.lit(True))


def composite(*policies: Column) -> Column:
    """All of them; none is true."""
    return reduce(lambda a, b: a & b, policies, F.lit(True))


def assembled(url: Column, seed: Column, same_origin: bool = True, include_subdomains: bool = False, allow: list[str] = [], deny: list[str] = [], include: list[str] = [], exclude: list[str] = []) -> Column:  # noqa: B006
    """The scope that a crawl's options make: the seed's origin, or its host and all under it, then domains, then patterns; without any all is in scope."""
    policies = []
    if same_origin:
        policies.append(let(strip_port(host_of(seed)), lambda root: subdomain(url, root)) if include_subdomains else exact_origin(url, seed))
    if allow or deny:
        policies.append(allow_deny(url, allow, deny))
    if include or exclude:
        policies.append(patterns(url, include, exclude))
    return composite(*policies)
