"""Synthetic sites as tables: pages rendered from what they hold, and requests served from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.functions.policy import quoted


def linked(link: Column, hosts: Column, own: Column) -> Column:
    """A link as it is written on a page of the host `own`: label:/path is absolute on another host of the map `hosts`, else a path."""
    label, path = F.regexp_extract(link, "^([^/:][^:]*):", 1), F.regexp_extract(link, "^[^/:][^:]*:(.*)$", 1)
    base = F.try_element_at(hosts, label)
    return F.when(label == "", link).when(base.isNotNull() & (label != own), F.concat(base, path)).otherwise(path)


def html_page(links: Column, scripts: Column, data: Column, forms: Column, padding_kb: Column) -> Column:
    """The markup of a page: anchors, scripts, data links, forms (array<struct<action,method,fields>>) and padding in a comment."""
    lines = lambda items, one: F.array_join(F.transform(items, one), "")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    fields = lambda f: lines(f["fields"], lambda x: text('<input type="text" name=', quoted(x), ">\n"))
    method = lambda f: F.coalesce(F.nullif(f["method"], F.lit("")), F.lit("get"))
    return F.concat(
        F.lit("<html><body>\n"),
        lines(links, lambda x, i: text("<a href=", quoted(x), ">link", i, "</a>\n")),
        lines(scripts, lambda x: text("<script src=", quoted(x), "></script>\n")),
        lines(data, lambda x, i: text("<div data-href=", quoted(x), ">datalink", i, "</div>\n")),
        lines(forms, lambda f, i: text("<form action=", quoted(f["action"]), " method=", quoted(method(f)), ">\n", fields(f), '<input type="submit" value="go', i, '">\n</form>\n')),
        F.when(padding_kb > 0, text("<!--", F.repeat(F.lit("x"), padding_kb * 1024), "-->\n")).otherwise(""),
        F.lit("</body></html>\n"),
    )


def script_page(endpoints: Column) -> Column:
    """A script with a call for each of array<struct<method,path>>."""
    call = lambda e: F.concat(F.lit("this.http."), F.lower(F.coalesce(F.nullif(e["method"], F.lit("")), F.lit("get"))), F.lit("("), quoted(e["path"]), F.lit(");\n"))
    return F.array_join(F.transform(endpoints, call), "")


def served(requests: DataFrame, site: DataFrame) -> DataFrame:
    """Requests (id, host, path, attempt) with status, location and body from a site (host, path, redirect, status, fail_first, fail_status, body).

    Paths are matched exactly; the first fail_first attempts at a page fail; a redirect is answered 301 and a page that is not there 404.
    """
    there = F.col("found").isNotNull()
    failed = F.col("attempt") < F.coalesce("fail_first", F.lit(0))
    moved = F.coalesce("redirect", F.lit("")) != ""
    status = F.when(~there, 404).when(failed, F.coalesce(F.nullif("fail_status", F.lit(0)), F.lit(503))).when(moved, 301).otherwise(F.coalesce(F.nullif("status", F.lit(0)), F.lit(200)))
    rows = requests.join(site.withColumn("found", F.lit(True)), ["host", "path"], "left")
    return rows.select("id", "host", "path", "attempt", status.cast("int").alias("answer"), F.when(there & ~failed & moved, F.col("redirect")).alias("location"), F.when(there & ~failed & ~moved, F.col("body")).alias("body"))


#: Twenty sites to measure with: name, shape, pages, width (children of a tree's node, columns of a grid), and of how many pages one redirects and one fails (0: none).
WORKLOADS = [
    ("single", "chain", 1, 0, 0, 0), ("pair", "ring", 2, 0, 0, 0), ("corridor", "chain", 30, 0, 0, 0), ("corridor-moved", "chain", 24, 0, 4, 0), ("corridor-broken", "chain", 18, 0, 0, 7),
    ("star", "fan", 60, 0, 0, 0), ("star-large", "fan", 400, 0, 0, 0), ("star-flaky", "fan", 80, 0, 0, 5), ("star-moved", "fan", 90, 0, 9, 0),
    ("binary", "tree", 63, 2, 0, 0), ("ternary", "tree", 121, 3, 0, 0), ("wide-tree", "tree", 273, 16, 0, 0), ("tree-rough", "tree", 200, 4, 11, 13),
    ("loop", "ring", 12, 0, 0, 0), ("loop-moved", "ring", 20, 0, 6, 0), ("streets", "grid", 48, 8, 0, 0), ("blocks", "grid", 100, 10, 0, 17), ("tangle", "web", 50, 0, 0, 0), ("tangle-large", "web", 300, 0, 0, 0), ("tangle-rough", "web", 150, 0, 8, 10),
]


def workload_pages(spark: SparkSession) -> DataFrame:
    """(workload, shape, n, width, page, status) of all pages of the workloads; the first page of each is plain."""
    rows = spark.createDataFrame(WORKLOADS, "workload string, shape string, n long, width long, moved_every long, failed_every long")
    rows = rows.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    every = lambda c: (F.col(c) > 0) & (F.col("page") > 0) & (F.try_mod(F.col("page"), F.col(c)) == F.col(c) - 1)
    return rows.select("workload", "shape", "n", "width", "page", F.when(every("failed_every"), 503).when(every("moved_every"), 301).otherwise(200).alias("status"))


def workload_links(spark: SparkSession) -> DataFrame:
    """(workload, src, dst, ord): where the pages of the workloads lead to. A page that fails leads nowhere; one that redirects leads to its first target only."""
    k, n, w = F.col("page"), F.col("n"), F.col("width")
    none = F.array().cast("array<bigint>")
    within = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(none)
    right, down = F.when((k % w < w - 1) & (k + 1 < n), F.array(k + 1)).otherwise(none), F.when(k + w < n, F.array(k + w)).otherwise(none)
    shape = F.col("shape")
    targets = (
        F.when(shape == "chain", within(k + 1, F.least(k + 1, n - 1)))
        .when(shape == "fan", F.when(k == 0, within(F.lit(1).cast("long"), n - 1)).otherwise(none))
        .when(shape == "tree", within(k * w + 1, F.least(k * w + w, n - 1)))
        .when(shape == "ring", F.array((k + 1) % n))
        .when(shape == "grid", F.concat(right, down))
        .otherwise(F.array((k * 7 + 3) % n, (k * 11 + 5) % n))
    )
    kept = F.when(F.col("status") == 503, none).when(F.col("status") == 301, F.slice(targets, 1, 1)).otherwise(targets)
    return workload_pages(spark).select("workload", k.alias("src"), F.posexplode(kept).alias("ord", "dst")).select("workload", "src", "dst", "ord")
