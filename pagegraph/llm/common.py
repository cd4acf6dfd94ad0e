"""What the operators of this subpackage share: shared storage, hot-key joins, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.storage import shared_dir, written as written  # noqa: PLC0414  passed on to the operators

#: Sub-keys that a key which may hold a third of all rows is spread over in a join.
SALTS = 16


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/pagegraph/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_table(df: DataFrame) -> None:
    """Deletes the files behind a written() table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, rows: int = 1000, mb: int = 16) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows and about `mb` MB, so that what is made of long texts does not pile up in a worker."""
    texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    sizes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(batch.num_rows, np.int64))
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        full = np.searchsorted(ends, (ends[at - 1] if at else 0) + (mb << 20), "right")
        end = min(batch.num_rows, at + rows, max(at + 1, int(full)))
        yield batch.slice(at, end - at)
        at = end


def bounded(spark: SparkSession, mb: int = 16) -> None:
    """Where the session has no bound of its own, its Arrow batches get one, the same for all operators: buffers of long texts would add up beside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(mb << 20))


def attach(many: DataFrame, one: DataFrame, keys: list[str], spread: list[str | Column], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Joins `one` (a row per key at most) to `many`, whose keys may be hot.

    Each row of `many` gets a sub-key from `spread`; `one` is repeated for each sub-key. Both sides
    are dealt anew by key and sub-key, so that adaptive execution can still split what stays large.
    """
    left = many.withColumn("_sub", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    # A merge join at every size: the plan does not change when `one` outgrows a broadcast.
    right = one.withColumn("_sub", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return left.join(right, [*keys, "_sub"], how).drop("_sub")


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, rows: int = 1000, mb: int = 16) -> DataFrame:
    """mapInArrow for a function of one batch, which gets it in slices."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows, mb):
                yield from work(part)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(a, b) links to (node, root): root is the smallest node reachable. Nodes without links have no row.

    Alternating large-star and small-star rounds, each written to the shared folder; the number
    of rounds grows with the logarithm of a component's diameter. Every round is a map-side
    combined minimum and a hot-key join, so a node with very many links is no single task.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = attach(both, low, ["a"], ["b"], "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, label)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = attach(large, low, ["a"], ["b"], "inner")
        nxt = written(star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), label)
        ends = nxt.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(nxt.select("b", F.lit(0), F.lit(1)))
        stars = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()
        drop_table(large)
        drop_table(now)
        now = nxt
        if stars:  # every node has one link, to a root: nothing can change any more
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
