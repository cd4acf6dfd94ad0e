"""Known answers of URL functions and scope predicates."""

import pytest
from pyspark.sql import functions as F

from pagegraph.functions import policy, scope, urls


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "strict", "expected"),
    [
        ("HtTp://Books.Example:80/Shelf/Three///", True, "http://books.example/Shelf/Three"),
        ("HtTp://Books.Example:80/Shelf/Three///", False, "http://books.example:80/Shelf/Three"),
        ("https://books.example:443?page=4#top", True, "https://books.example/?page=4"),
        ("https://books.example:443?page=4#top", False, "https://books.example:443/?page=4"),
        ("http://books.example:443/", True, "http://books.example:443/"),
        ("https://me:pw@Books.example/a", True, "https://me:pw@books.example/a"),
        ("ftp://books.example:21/a;type=i", True, "ftp://books.example:21/a;type=i"),
        ("https://books.example/sh%65lf%2F9", True, "https://books.example/shelf/9"),
        ("https://books.example/regal/f%c3%bcnf", True, "https://books.example/regal/f%C3%BCnf"),
        ("https://books.example/50%-off", True, "https://books.example/50%-off"),
        ("https://books.example/q?#", True, "https://books.example/q"),
        ("https://books.example:x9/q/", True, "https://books.example:x9/q/"),
        ("tel:+49-30-1", True, "tel:+49-30-1"),
        ("shelf/7/#end", True, "shelf/7"),
        ("", True, "/"),
    ],
)
def test_canonicalize(spark, url, strict, expected):
    assert one(spark, urls.canonicalize(F.col("u"), strict=strict), u=url) == expected


def test_sorted_query(spark):
    assert one(spark, urls.canonicalize(F.col("u"), sort_query=True), u="https://books.example/find?year=1999&by=lem&by=dick&open") == "https://books.example/find?by=dick&by=lem&open=&year=1999"


@pytest.mark.parametrize(
    ("ref", "expected"),
    [("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d?y"), ("g?y", "http://a/b/c/g?y"), ("", "http://a/b/c/d?q"), (".", "http://a/b/c/"), ("..", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../../g", "http://a/g"), ("g;x=1/../y", "http://a/b/c/y")],
)
def test_resolve(spark, ref, expected):
    assert one(spark, urls.resolve(F.col("b"), F.col("r")), b="http://a/b/c/d?q", r=ref) == expected


@pytest.mark.parametrize(("url", "expected"), [("https://example.com/page", True), ("https://example.com:443/page", False), ("http://example.com/page", False), ("https://sub.example.com/", False), ("https://other.example/", False)])
def test_exact_origin(spark, url, expected):
    assert one(spark, scope.exact_origin(F.col("u"), F.lit("https://example.com/")), u=url) is expected


@pytest.mark.parametrize(("url", "expected"), [("https://example.com/", True), ("https://app.example.com/", True), ("https://deep.app.example.com:8443/", True), ("https://notexample.com/", False), ("https://example.com.evil.com/", False)])
def test_subdomain(spark, url, expected):
    assert one(spark, scope.subdomain(F.col("u"), F.lit("example.com")), u=url) is expected


def test_retry(spark):
    decide = lambda a, s, e: one(spark, policy.should_retry(F.col("a"), F.col("s"), F.col("e"), 2), a=a, s=s, e=e)
    assert spark.createDataFrame([(0, 500, None)], "a int, s int, e string").select(policy.should_retry(F.col("a"), F.col("s"), F.col("e"), 2).alias("x")).first().x
    assert not decide(2, 500, "timeout")
    assert one(spark, policy.legacy_delay_ms(F.col("h")), h="7") == 7000
    assert one(spark, policy.legacy_delay_ms(F.col("h")), h="2") == 5000
    for header, ms in ((".5", 500), ("5.", 5000), ("1e3", 1_000_000), ("+2", 2000), ("-1", 0), ("nan", 0), ("Wed, 21 Oct 2015 07:28:00 GMT", 0), ("", 0)):
        assert one(spark, policy.retry_after_ms(F.col("h")), h=header) == ms


def test_basic_auth_and_tokens(spark):
    assert one(spark, policy.basic_auth(F.col("c")), c="alice:pass:with:colons") == "Basic YWxpY2U6cGFzczp3aXRoOmNvbG9ucw=="
    assert one(spark, policy.token_from_json(F.col("c")), c='{"token": "", "access_token": "t"}') == "t"
