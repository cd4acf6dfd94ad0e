"""Statistics of repeated runs: order statistics, effect sizes, verdicts, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.functions.policy import classify_ratio
from pagegraph.operators.ranks import numbered


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value that at least p of the values do not exceed; for groups of few different values."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("bigint")


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, x, n, upto, all): the different values of each key, their counts, and how many values are not larger. Nulls do not count.

    Rows are summed by key and value first, so a key with most rows is no single task, and what is ordered is spilled, not held.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("x")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    return counts.withColumns({"upto": F.sum("n").over(w.orderBy("x")), "all": F.sum("n").over(w)})


def at_rank(p: float) -> Column:
    """Of counted() rows the nearest-rank quantile, as an aggregate."""
    return F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * p), F.col("x")))


def metric_stats(rows: DataFrame, key: str, value: str) -> DataFrame:
    """min, max, mean (whole), median, p90, p95, p99, stddev (whole) per key, from the counts of its different values."""
    x, n = F.col("x"), F.col("n")
    out = counted(rows, [key], value).groupBy(key).agg(
        F.sum("n").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum(x * n).alias("s"), *[at_rank(p).alias(name) for name, p in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))],
    )
    spread = rows.groupBy(key).agg(F.floor(F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("stddev"))
    return out.join(spread, key).select(key, "n", "min", "max", F.floor(F.col("s") / F.col("n")).alias("mean"), "median", "p90", "p95", "p99", "stddev")


def mad(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Median absolute deviation about the nearest-rank median."""
    counts = counted(rows, [key], value)
    middle = counts.groupBy(key).agg(at_rank(0.5).alias("middle"))
    off = counts.join(middle, key).select(key, "n", F.abs(F.col("x") - F.col("middle")).alias("off")).groupBy(key, "off").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(key)
    ranked = off.withColumns({"upto": F.sum("n").over(w.orderBy("off")), "all": F.sum("n").over(w)}).withColumnRenamed("off", "x")
    return ranked.groupBy(key).agg(at_rank(0.5).alias("mad"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """sorted[n / 2] of each key; rows are counted by value first, so only different values of a key are ordered."""
    return counted(rows, [key], value).where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(key).agg(F.min("x").alias("median"))


def median_row(rows: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """The row with the lower median of each key: of the rows with that value the one that the tie's order puts there."""
    counts = counted(rows, [key], value).withColumn("k", F.floor((F.col("all") + 1) / 2))
    middle = counts.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))).select(F.col(key).alias("_key"), F.col("x").alias("_x"), (F.col("k") - F.col("upto") + F.col("n")).alias("_k"))
    same = rows.join(middle, (F.col(key) == F.col("_key")) & (F.col(value) == F.col("_x")))
    return numbered(same, [key], [tie], "_place").where(F.col("_place") == F.col("_k")).select(rows.columns)


def averaged_median(value: str) -> Column:
    """The mean of the middle two, cut to a whole number."""
    return F.floor(F.expr(f"median({value})")).cast("bigint")


def discard_warmups(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """Rows of each key after its first k: only k rows of a key are ranked, and a row's place is told by the last of them."""
    first = rows.select(key, F.struct(*order).alias("_at")).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).where(F.col("_n") <= k)
    last = first.groupBy(key).agg(F.max("_at").alias("_last"))
    return rows.join(last, key).where(F.struct(*order) > F.col("_last")).drop("_last")


def cliffs_delta(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Cliff's delta of a against b per key, from ranks: no pair of samples is ever a row.

    The count of smaller minus larger values of b for each value of a comes from running sums over the
    values of both, per key, counted by distinct value first.
    """
    both = a.select(key, F.col(value).alias("x"), F.lit(1).alias("na"), F.lit(0).alias("nb")).union(b.select(key, value, F.lit(0), F.lit(1)))
    counts = both.groupBy(key, "x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    w = Window.partitionBy(key)
    below = F.coalesce(F.sum("nb").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumns({"below": below, "all_b": F.sum("nb").over(w)})
    wins = F.sum(F.col("na") * (F.col("below") - (F.col("all_b") - F.col("below") - F.col("nb"))))
    out = ranked.groupBy(key).agg(wins.alias("wins"), F.sum("na").alias("n_a"), F.sum("nb").alias("n_b")).where("n_a > 0 and n_b > 0")
    delta = F.round(F.col("wins") / (F.col("n_a") * F.col("n_b")), 9)
    return out.select(key, delta.alias("delta")).withColumn("magnitude", magnitude(F.col("delta")))


def magnitude(delta: Column) -> Column:
    size = F.abs(delta)
    return F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 that follows from the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def gamma(k: Column, u: Column, v: Column) -> Column:
    """A gamma distributed number of shape k from two uniform ones: by the cube of a normal number, for shape 1 exactly."""
    z = F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * v)
    return F.when(k == 1, -F.ln(u)).otherwise(k * F.pow(F.greatest(1 - 1 / (9 * k) + z / (3 * F.sqrt(k)), F.lit(1e-3)), F.lit(3.0)))


def bootstrap_ci(rows: DataFrame, key: str, group: str, value: str, resamples: int = 2000, seed: int = 1) -> DataFrame:
    """95 % interval of the median of group a less that of group b, per key, from resamples of all samples at their full size.

    No resample is made: of n picks with replacement the m-th smallest is the sample at rank n * u, where u is the m-th
    smallest of n uniform numbers, which is beta distributed. The mean of the middle two of an even number is cut to a
    whole number. Numbers follow from (seed, key, group, resample), so a run can be repeated.
    """
    at = [key, group]
    counts = rows.where(F.col(group).isin("a", "b") & F.col(value).isNotNull()).groupBy(*at, F.col(value).alias("x")).agg(F.count("*").alias("n"))
    upto = counts.select(*at, F.sum("n").over(Window.partitionBy(*at).orderBy("x")).alias("rank"), "x", F.lit(None).cast("int").alias("r"))
    draws = counts.groupBy(*at).agg(F.sum("n").cast("double").alias("n")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    number = lambda k: uniform(F.lit(str(seed)), F.col(key).cast("string"), F.col(group), F.col("r").cast("string"), F.lit(str(k)))
    draws = draws.withColumn("m", F.floor((F.col("n") + 1) / 2).cast("double")).withColumn("g", gamma(F.col("m"), number(1), number(2)))
    draws = draws.withColumn("u", F.col("g") / (F.col("g") + gamma(F.col("n") - F.col("m") + 1, number(3), number(4))))
    above = F.col("u") + (1 - F.col("u")) * (1 - F.pow(number(5), 1 / (F.col("n") - F.col("m"))))  # the least of the picks above u
    ranks = F.array("u", F.when(F.col("n") % 2 == 0, above).otherwise(F.col("u")))
    draws = draws.select(*at, F.explode(ranks).alias("u"), "n", F.lit(None).cast(upto.schema["x"].dataType).alias("x"), "r")
    draws = draws.select(*at, F.least(F.col("n"), F.floor(F.col("n") * F.col("u")) + 1).cast("bigint").alias("rank"), "x", "r")
    # From the highest rank down, values before draws: the last value seen is the smallest whose running count reaches the draw's rank.
    w = Window.partitionBy(*at).orderBy(F.desc("rank"), F.col("r").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    drawn = upto.union(draws).withColumn("x", F.last("x", ignorenulls=True).over(w)).where(F.col("r").isNotNull())
    middle = lambda name: F.floor(F.sum(F.when(F.col(group) == name, F.col("x"))) / 2)
    both = drawn.groupBy(key, "r").agg(middle("a").alias("a"), middle("b").alias("b")).where("a is not null and b is not null")
    low, high = int(resamples * 0.025), int(resamples * 0.975)
    return both.groupBy(key).agg(F.array_sort(F.collect_list(F.col("a") - F.col("b"))).alias("s")).select(key, F.get("s", F.lit(low)).alias("ci_low"), F.get("s", F.lit(high)).alias("ci_high"))


def scaling_ratios(points: DataFrame) -> DataFrame:
    """Ratios of neighbouring measured points (family, scale, value, excluded), skipping the excluded ones."""
    w = Window.partitionBy("family").orderBy("scale")
    rows = points.where("not excluded").withColumns({"scale_before": F.lag("scale").over(w), "value_before": F.lag("value").over(w)}).where("scale_before is not null")
    rows = rows.withColumns({"scale_ratio": F.col("scale") / F.col("scale_before"), "ratio": F.when(F.col("value_before") > 0, F.col("value") / F.col("value_before")).otherwise(0.0)})
    return rows.select("family", "scale_before", "scale", F.round("scale_ratio", 9).alias("scale_ratio"), F.round("ratio", 9).alias("ratio"), classify_ratio(F.col("ratio"), F.col("scale_ratio")).alias("class"))


def exclusion_cascade(points: DataFrame, ceiling: Column) -> DataFrame:
    """A scale beyond the ceiling excludes itself and all larger ones of its family."""
    w = Window.partitionBy("family").orderBy("scale").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("excluded", F.max(ceiling.cast("int")).over(w) == 1)
