"""Readers and writers of page snapshots and event lines, through Spark's own sources only."""

from __future__ import annotations

import platform
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.storage import written


def read_pages(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Page snapshots as Parquet; only the columns asked for are read."""
    pages = spark.read.parquet(path)
    return pages.select(*columns) if columns else pages


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Event lines; lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_events(events: DataFrame, path: str) -> None:
    """One JSON line per event; empty fields are left out, and <, > and & escaped."""
    from pagegraph.functions.policy import html_safe_json

    events.select(html_safe_json(F.to_json(F.struct("*"))).alias("value")).write.text(path)


def write_all(events: DataFrame, writers: list[Callable[[DataFrame], None]]) -> None:
    """Gives the same events to several writers, one after the other; the first that fails ends it. The events are made once."""
    kept = written(events, "events")
    for write in writers:
        write(kept)


def routed(out: str | None, lines: Callable[[str], Callable[[DataFrame], None]], shown: Callable[[DataFrame], None]) -> list[Callable[[DataFrame], None]]:
    """The writers of an output option: - is lines alone, a path is lines there and what is shown, none is what is shown."""
    if out == "-":
        return [lines("-")]
    return [shown, lines(out)] if out else [shown]


def environment(spark: SparkSession) -> DataFrame:
    """One row that tells where a run took place: system, versions, cores and memory settings."""
    conf = spark.sparkContext.getConf()
    rows = [(platform.system(), platform.machine(), platform.release(), platform.python_version(), spark.version, spark.sparkContext.defaultParallelism, conf.get("spark.executor.memory", ""))]
    return spark.createDataFrame(rows, "os string, arch string, kernel string, python string, spark string, cores int, executor_memory string")
