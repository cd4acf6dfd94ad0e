"""URLs in the output of other crawlers, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.functions.urls import resolve

#: Fixed value: lines in brackets that name a URL.
BRACKETS = "^\\[(?:url|javascript|linkfinder)\\]\\s*-\\s*(?:\\[code-\\d+\\]\\s*-\\s*)?(?:\\[from:[^\\]]*\\]\\s*-\\s*)?(.+)$"


def _found(rows: DataFrame, seed_too: bool) -> DataFrame:
    found = rows.where("url <> ''").select("run", "url")
    if seed_too:  # the tool does not name the page it started from, which it fetched as well
        found = found.union(rows.select("run", F.col("seed").alias("url")))
    return found.distinct()


def event_lines(lines: DataFrame) -> DataFrame:
    """(run, url) of the pages in event lines (run, seed, line); other lines are passed over."""
    e = F.from_json("line", "struct<type:string,url:string>", {"mode": "PERMISSIVE"})
    return _found(lines.select("run", "seed", F.when(e["type"] == "page", e["url"]).alias("url")), False)


def request_lines(lines: DataFrame) -> DataFrame:
    """(run, url) of JSON lines that hold the URL as request.endpoint."""
    return _found(lines.select("run", "seed", F.get_json_object("line", "$.request.endpoint").alias("url")), False)


def flat_lines(lines: DataFrame) -> DataFrame:
    """(run, url) of JSON lines that hold it as URL, and the seed."""
    return _found(lines.select("run", "seed", F.get_json_object("line", "$.URL").alias("url")), True)


def bracket_lines(lines: DataFrame) -> DataFrame:
    """(run, url) of plain lines [kind] - URL, resolved against the seed, and the seed. Form lines name no URL of their own."""
    raw = F.btrim(F.regexp_extract(F.btrim("line"), BRACKETS, 1))
    return _found(lines.select("run", "seed", F.when(raw != "", resolve(F.col("seed"), raw)).alias("url")), True)


def run_summary(lines: DataFrame) -> DataFrame:
    """Per run of event lines: the figures of its summary line and the bytes of its pages; ok tells whether there was a summary."""
    fields = ["active_wall_ns", "retry_backoff_ns", "retry_attempts", "requests_made", "responses_ok"]
    e = F.from_json("line", f"struct<type:string,bytes_read:bigint,{','.join(f'{f}:bigint' for f in fields)}>", {"mode": "PERMISSIVE"})
    rows = lines.select("run", e.alias("e"))
    told = [F.coalesce(F.max(F.when(F.col("e.type") == "summary", F.coalesce(F.col(f"e.{f}"), F.lit(0)))), F.lit(0)).alias(f) for f in fields]
    return rows.groupBy("run").agg(*told, F.coalesce(F.sum(F.when(F.col("e.type") == "page", F.col("e.bytes_read"))), F.lit(0)).alias("bytes_received"), (F.count_if(F.col("e.type") == "summary") > 0).alias("ok"))
