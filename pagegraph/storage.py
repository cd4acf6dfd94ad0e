"""Tables in the shared folder, which cut the lineage of iterative plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests), one in the warehouse, which executors see too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared").rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/pagegraph/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """A written() table and the number of its rows, counted while it is written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, seen.get["n"]
