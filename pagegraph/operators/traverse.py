"""Breadth-first traversal, redirect chains and generated site graphs over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagegraph.storage import written, written_counted


def levels(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth) of pages reached from seeds (url) over edges (src, dst), at their least depth.

    As bfs() without the order of discovery: a level is one join, one distinct and one anti-join, and is written.
    """
    level, found = written_counted(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "levels")
    seen = level
    for depth in range(1, max_depth + 1):
        reached = level.select(F.col("url").alias("src")).join(edges, "src").select(F.col("dst").alias("url")).distinct()
        level, found = written_counted(reached.join(seen, "url", "left_anti").select("url", F.lit(depth).alias("depth")), "levels")
        if not found:
            break
        seen = seen.union(level)
    return seen


def bfs(seeds: DataFrame, edges: DataFrame, max_depth: int, max_pages: int = 0) -> DataFrame:
    """(url, parent, depth) of pages reached from seeds (url) over edges (src, dst, ord).

    One level at a time; a page's parent is the first in the order (parent's place in its level, place of the link).
    Every level is written to the shared folder, so the plan of a level holds one join, one minimum per
    page and one anti-join, whatever the depth. max_pages (0: none) cuts in the order of discovery.
    """
    level, found = written_counted(seeds.select("url").distinct().orderBy("url").select("url", F.lit(None).cast(seeds.schema["url"].dataType).alias("parent"), F.lit(0).alias("depth"), F.monotonically_increasing_id().alias("place")), "bfs")
    seen, counts = level, {0: found}
    for depth in range(1, max_depth + 1):
        reached = level.select(F.col("url").alias("src"), F.col("place").alias("parent_place")).join(edges, "src")
        first = reached.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("parent_place", "ord", "src")).alias("f"))
        new = first.join(seen.select("url"), "url", "left_anti")
        new = new.select("url", F.col("f.src").alias("parent"), F.lit(depth).alias("depth"), "f.parent_place", "f.ord")
        # Sorted by ranges, partitions and the numbers in them follow the order of discovery.
        level, found = written_counted(new.orderBy("parent_place", "ord", "url").select("url", "parent", "depth", F.monotonically_increasing_id().alias("place")), "bfs")
        if not found:
            break
        counts[depth] = found
        seen = seen.unionByName(level)
    if max_pages:
        # The order is over depth ranges: pages of whole levels are counted first, only one level is ranked.
        left, cut = max_pages, -1
        for depth in sorted(counts):
            if counts[depth] > left:
                cut = depth
                break
            left -= counts[depth]
        if cut >= 0:
            part = seen.where(F.col("depth") == cut).orderBy("place", "url").limit(left)
            seen = seen.where(F.col("depth") < cut).unionByName(part)
    return seen.drop("place")


def redirect_chains(edges: DataFrame, most: int = 20) -> DataFrame:
    """(src, final, hops, looped) of redirects src -> dst, one per source; a chain of more hops than `most` is looped.

    Jumps of 1, 2, 4, ... hops, which stop at a chain's end, are joined to one of most + 1 hops: the number of joins
    grows with the logarithm of `most`. A looped chain's final is where that many hops lead.
    """

    def joined(one: DataFrame, two: DataFrame) -> DataFrame:
        further = two.select(F.col("src").alias("final"), F.col("final").alias("next"), F.col("hops").alias("more"))
        return one.join(further, "final", "left").select("src", F.coalesce("next", "final").alias("final"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))

    jump = edges.select("src", F.col("dst").alias("final"), F.lit(1).alias("hops"))
    out, left = None, most + 1
    while left:
        if left % 2:
            out = jump if out is None else joined(out, jump)
        left //= 2
        if left:
            jump = written(joined(jump, jump), "redirects")
    return out.select("src", "final", "hops", (F.col("hops") > most).alias("looped"))


def chain(spark: SparkSession, prefix: str, n: int) -> DataFrame:
    """Pages prefix0 .. prefix(n-1), each linking to the next: (src, dst, ord); the last links to nothing."""
    page = lambda c: F.concat(F.lit(prefix), c.cast("string"))
    return spark.range(n).select(page(F.col("id")).alias("src"), F.when(F.col("id") < n - 1, page(F.col("id") + 1)).alias("dst"), F.lit(0).alias("ord"))


def fanout(spark: SparkSession, root: str, leaf: str, n: int) -> DataFrame:
    return spark.range(n).select(F.lit(root).alias("src"), F.concat(F.lit(leaf), F.col("id").cast("string")).alias("dst"), F.col("id").cast("int").alias("ord"))


def tree(spark: SparkSession, n: int, arity: int = 10) -> DataFrame:
    """A complete tree of n nodes: node k > 0 hangs under (k - 1) div arity."""
    return spark.range(1, n).select(F.floor((F.col("id") - 1) / arity).alias("src"), F.col("id").alias("dst"), ((F.col("id") - 1) % arity).cast("int").alias("ord"))


def coverage(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: hits, extra, missing and recall of the distinct (keys, path) found against the truth."""
    both = found.select(*keys, "path").distinct().withColumn("f", F.lit(1)).join(truth.select(*keys, "path").distinct().withColumn("t", F.lit(1)), [*keys, "path"], "full")
    out = both.groupBy(*keys).agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("hits"), F.count_if(F.col("t").isNull()).alias("extra"), F.count_if(F.col("f").isNull()).alias("missing"))
    return out.withColumn("recall", F.round(F.coalesce(F.try_divide(F.col("hits") * 100.0, F.col("hits") + F.col("missing")), F.lit(0.0)), 6))


def ranked(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order, with their place."""
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))
