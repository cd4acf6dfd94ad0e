"""Queries over API documents built from the table part."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.operators import openapi
from pagegraph.registry import Registry, dealt, table

R = Registry()

SECOND = {
    "swagger": "2.0", "basePath": "/shop/", "parameters": {"Branch": {"name": "branch", "in": "path"}}, "definitions": {"Loan": {"properties": {"until": {}, "reader": {}, "book": {}}}},
    "paths": {
        "/branches/{branch}/loans": {
            "parameters": [{"$ref": "#/parameters/Branch"}, {"name": "lang", "in": "query"}],
            "delete": {"parameters": [{"name": "lang", "in": "header"}, {"name": "force", "in": "query"}]},
            "patch": {"parameters": [{"in": "body", "name": "loan", "schema": {"$ref": "#/definitions/Loan"}}]},
        },
        "/covers": {"put": {"parameters": [{"in": "formData", "name": "scan"}, {"in": "formData", "name": "isbn"}, {"$ref": "#/parameters/Missing"}]}},
    },
}
THIRD = {
    "openapi": "3.1.0", "servers": [{"url": "https://lib.example/core/v7/"}, {"url": "/other"}],
    "components": {"requestBodies": {"Note": {"content": {"text/plain": {"schema": {"properties": {"never": {}}}}, "application/json": {"schema": {"properties": {"stars": {}, "by": {}}}}}}}},
    "paths": {
        "/readers": {"head": {}, "get": {"parameters": [{"name": "page", "in": "query"}, {"name": "sort", "in": "query"}]}},
        "/books/{isbn}/notes": {"parameters": [{"name": "isbn", "in": "path"}], "post": {"requestBody": {"$ref": "#/components/requestBodies/Note"}}},
    },
}
#: A YAML document whose version is a number, which is no version 2.
PLAIN = "swagger: 2.0\nbasePath: /gone\npaths:\n  /clock/{zone}:\n    trace:\n      parameters:\n        - name: zone\n          in: path\n"
ORIGIN = "concat('https://a', p_partkey, '.example"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    body = F.when(k % 4 == 0, json.dumps(SECOND)).when(k % 4 == 1, json.dumps(THIRD)).when(k % 4 == 2, PLAIN).otherwise("free text")
    return dealt(spark, sf_dir, "part", "p_partkey").select(F.concat(F.lit("https://a"), k.cast("string"), F.lit(".example/spec.json")).alias("source_url"), body.alias("body"))


def _rows(rest: int, *rows: tuple[str, str, str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {ORIGIN}{url}') AS url, '{m}' AS method, '{p}' AS path_params, '{q}' AS query_params, '{b}' AS body_params FROM part WHERE p_partkey % 4 = {rest}" for url, m, p, q, b in rows)


TWO = _rows(0, ("/shop/branches/{branch}/loans", "DELETE", "branch", "lang,force", ""), ("/shop/branches/{branch}/loans", "PATCH", "branch", "lang", "book,reader,until"), ("/shop/covers", "PUT", "", "", "scan,isbn"))
THREE = _rows(1, ("/core/v7/books/{isbn}/notes", "POST", "isbn", "", "by,stars"), ("/core/v7/readers", "GET", "", "page,sort", ""), ("/core/v7/readers", "HEAD", "", "", ""))
PING = _rows(2, ("/clock/{zone}", "TRACE", "zone", "", ""))


def flat(spark: SparkSession, sf_dir: str, rests: list[int]) -> DataFrame:
    rows = openapi.flattened(documents(spark, sf_dir)).where((F.regexp_extract("source_url", "//a([0-9]+)", 1).cast("int") % 4).isin(rests))
    joined = [F.array_join(c, ",").alias(c) for c in ("path_params", "query_params", "body_params")]
    return rows.select("url", "method", *joined)


@R.add("openapi_v2", TWO)
def openapi_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, [0])


@R.add("openapi_v3", THREE)
def openapi_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, [1])


@R.add("openapi_load", f"SELECT url, method FROM ({TWO} UNION ALL {THREE} UNION ALL {PING})")
def openapi_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, [0, 1, 2, 3]).select("url", "method")


@R.add("openapi_params", f"SELECT path_params, query_params, body_params, count(*) AS n FROM ({TWO} UNION ALL {THREE}) GROUP BY ALL")
def openapi_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, [0, 1]).groupBy("path_params", "query_params", "body_params").agg(F.count("*").alias("n"))


@R.add("openapi_ref", f"SELECT url, path_params, body_params FROM ({TWO}) WHERE method = 'PATCH'")
def openapi_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, [0]).where("method = 'PATCH'").select("url", "path_params", "body_params")


@R.add("openapi_order", f"SELECT {ORIGIN}/spec.json') AS source_url, unnest([0, 1, 2])::INTEGER AS ord, unnest(['DELETE', 'PATCH', 'PUT']) AS method FROM part WHERE p_partkey % 4 = 0")
def openapi_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = openapi.flattened(documents(spark, sf_dir)).where("raw_path like '/branches%' or raw_path = '/covers'")
    return rows.select("source_url", "ord", "method")


@R.add("openapi_probe", f"SELECT {ORIGIN}') AS origin, CASE p_partkey % 3 WHEN 0 THEN '/swagger.json' WHEN 1 THEN '/api-docs' ELSE '/redoc' END AS place FROM part")
def openapi_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each origin the first place, in the fixed order, that the snapshot has."""
    k = F.col("p_partkey")
    origins = table(spark, sf_dir, "part").select(F.concat(F.lit("https://a"), k.cast("string"), F.lit(".example")).alias("origin"), k)
    has = F.when(k % 3 == 0, F.array(F.lit("/redoc"), F.lit("/swagger.json"))).when(k % 3 == 1, F.array(F.lit("/openapi/x"), F.lit("/api-docs"))).otherwise(F.array(F.lit("/redoc")))
    snapshot = origins.select("origin", F.explode(has).alias("place"))
    order = spark.createDataFrame(list(enumerate(openapi.PLACES)), "ord int, place string")
    return snapshot.join(F.broadcast(order), "place").groupBy("origin").agg(F.min_by("place", "ord").alias("place"))  # nineteen rows, always


QUERIES, ORACLES = R.queries, R.oracles
