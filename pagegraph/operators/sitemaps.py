"""Sitemaps: their documents, how they are found for an origin, and the seeds that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.functions.urls import canonicalize
from pagegraph.storage import written, written_counted

#: Places in an origin's queue of documents that are looked at, and the bytes of a document at most.
MOST, BYTES = 51, 50 << 20
#: A Sitemap line of a robots file; byte order marks and comments do not count.
LINE = "(?i)^[﻿\\s]*sitemap:\\s*(https?://[^#]*?)\\s*(?:#.*)?$"


def directives(files: DataFrame) -> DataFrame:
    """(origin, ord, url) of the Sitemap lines in robots files (origin, body)."""
    lines = files.select("origin", F.posexplode(F.split("body", "\n")).alias("ord", "line"))
    return lines.select("origin", "ord", F.regexp_extract("line", LINE, 1).alias("url")).where("url <> ''")


def parsed(documents: DataFrame) -> DataFrame:
    """(url, is_index, locs) of documents (url, status, body): the absolute locations, without blanks, in order.

    The root's name tells an index, whatever else stands in it. What failed, is too long or is not well formed has no row.
    """
    ok = documents.where((F.col("status") < 400) & (F.octet_length("body") <= BYTES))
    root = F.lower(F.regexp_extract("body", "(?s)^(?:\\s|<\\?.*?\\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<(?:[A-Za-z0-9_.-]+:)?([A-Za-z0-9_.-]+)", 1))
    tree = F.from_xml("body", "struct<url:array<struct<loc:string>>,sitemap:array<struct<loc:string>>,_broken:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = ok.select("url", (root == "sitemapindex").alias("is_index"), tree.alias("t")).where("t is not null and t._broken is null")
    locs = F.transform(F.when(F.col("is_index"), F.col("t.sitemap")).otherwise(F.col("t.url")), lambda x: F.btrim(x["loc"], F.lit(" \t\n\r")))
    return rows.select("url", "is_index", F.coalesce(F.filter(locs, lambda x: x.rlike("^https?://")), F.array().cast("array<string>")).alias("locs"))


def discovered(origins: DataFrame, files: DataFrame, documents: DataFrame, limit: int = 0) -> DataFrame:
    """(origin, place, ord, loc): the locations that the sitemaps of origins (origin) give, in order.

    An origin's queue starts with the Sitemap lines of its robots file, or with /sitemap.xml if there are none. The children of an
    index come to the queue's end; of the first MOST places those that repeat an earlier one are passed over. With a limit
    (0: none) no document is read any more once there are so many locations.
    """
    told = directives(files.join(origins, "origin"))
    usual = origins.join(told.select("origin").distinct(), "origin", "left_anti").select("origin", F.lit(0).alias("ord"), F.concat("origin", F.lit("/sitemap.xml")).alias("url"))
    docs = written(parsed(documents), "sitemaps")
    number = F.row_number().over(Window.partitionBy("origin").orderBy("parent", "ord")) - 1  # a queue has MOST places, and an index is cut to as many
    level = told.union(usual).withColumn("parent", F.lit(0)).withColumn("place", number).select("origin", "place", "url").where(F.col("place") < MOST)
    level, found = written_counted(level, "sitemap-queue")
    queue = level
    while found:  # a level of an index below another; each takes a place at least
        first = Window.partitionBy("origin", "url").orderBy("place")
        live = queue.withColumn("again", F.row_number().over(first) > 1).where("not again").select("origin", "place")
        length = queue.groupBy("origin").agg(F.count("*").alias("taken"))
        children = level.join(live, ["origin", "place"]).join(docs.where("is_index"), "url").select("origin", F.col("place").alias("parent"), F.posexplode(F.slice("locs", 1, MOST)).alias("ord", "url"))
        below = children.withColumn("k", number).join(length, "origin").withColumn("place", (F.col("k") + F.col("taken")).cast("int"))
        level, found = written_counted(below.where(F.col("place") < MOST).select("origin", "place", "url"), "sitemap-queue")
        queue = queue.union(level)
    first = Window.partitionBy("origin", "url").orderBy("place")
    read = queue.withColumn("again", F.row_number().over(first) > 1).where("not again").join(docs.where("not is_index"), "url")
    before = F.coalesce(F.sum(F.size("locs")).over(Window.partitionBy("origin").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    read = read.withColumn("before", before)
    return (read.where(F.col("before") < limit) if limit else read).select("origin", "place", F.posexplode("locs").alias("ord", "loc"))


def seeds(locs: DataFrame, max_frontier: int, max_pages: int = 0) -> DataFrame:
    """(origin, url, parent_url, depth, via): the locations of an origin's own that enter the frontier, each once, as long as there is room.

    There is room for max_frontier less one, and for max_pages if it is not 0.
    """
    limit = min(max_frontier - 1, max_pages) if max_pages > 0 else max_frontier - 1
    own = locs.where(F.lower(F.regexp_extract("loc", "^(https?://[^/?#]*)", 1)) == F.lower("origin"))
    new = own.groupBy("origin", canonicalize(F.col("loc")).alias("url")).agg(F.min(F.struct("place", "ord")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("origin").orderBy("at"))
    kept = new.withColumn("rank", rank).where(F.col("rank") <= max(0, limit))
    return kept.select("origin", "url", F.concat("origin", F.lit("/")).alias("parent_url"), F.lit(0).alias("depth"), F.lit("sitemap").alias("via"))
