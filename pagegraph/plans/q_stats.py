"""Queries over repeated runs, tools and scales. Runs come from the table events, metrics from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagegraph.functions import policy
from pagegraph.operators import stats
from pagegraph.registry import Registry, table

R = Registry()

#: Durations of a workload's runs: events of a type in the order of their time.
S = "s AS (SELECT event_type AS workload, event_id AS run, ts, user_id, CAST(floor(value * 1000) AS BIGINT) AS d FROM events)"
#: Two tools that ran the same workloads.
AB = "ab AS (SELECT workload, run, d, CASE WHEN run % 2 = 0 THEN 'a' ELSE 'b' END AS tool FROM s)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("workload"), F.col("event_id").alias("run"), "ts", "user_id", F.floor(F.col("value") * 1000).cast("bigint").alias("d"))


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("tool", F.when(F.col("run") % 2 == 0, "a").otherwise("b"))


@R.add("metric_stats", f"WITH {S} SELECT workload, count(*) AS n, min(d) AS min, max(d) AS max, floor(sum(d) / count(*))::BIGINT AS mean, quantile_disc(d, 0.5) AS median, quantile_disc(d, 0.9) AS p90, quantile_disc(d, 0.95) AS p95, quantile_disc(d, 0.99) AS p99, floor(coalesce(stddev_samp(d), 0))::BIGINT AS stddev FROM s GROUP BY workload")
def metric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.metric_stats(samples(spark, sf_dir), "workload", "d")


@R.add("percentile_nearest_rank", f"WITH {S} SELECT workload, quantile_disc(d, 0.25) AS p25, quantile_disc(d, 0.75) AS p75 FROM s GROUP BY workload")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counted(samples(spark, sf_dir), ["workload"], "d").groupBy("workload").agg(stats.at_rank(0.25).alias("p25"), stats.at_rank(0.75).alias("p75"))


@R.add("mad", f"WITH {S}, m AS (SELECT workload, quantile_disc(d, 0.5) AS m FROM s GROUP BY workload) SELECT workload, quantile_disc(abs(d - m), 0.5) AS mad FROM s JOIN m USING (workload) GROUP BY workload")
def mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mad(samples(spark, sf_dir), "workload", "d")


@R.add("upper_median", f"WITH {S}, k AS (SELECT workload, d, row_number() OVER (PARTITION BY workload ORDER BY d, run) AS k, count(*) OVER (PARTITION BY workload) AS n FROM s) SELECT workload, d AS median FROM k WHERE k = n // 2 + 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.upper_median(samples(spark, sf_dir), "workload", "d")


@R.add("avg_median", f"WITH {S} SELECT workload, floor(median(d))::BIGINT AS median FROM s GROUP BY workload")
def avg_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("workload").agg(stats.averaged_median("d").alias("median"))


@R.add("discard_warmups", f"WITH {S}, k AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY ts, run) AS k FROM s) SELECT workload, count(*) AS runs, sum(d)::BIGINT AS total FROM k WHERE k > 5 GROUP BY workload")
def discard_warmups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.discard_warmups(samples(spark, sf_dir), "workload", ["ts", "run"], 5).groupBy("workload").agg(F.count("*").alias("runs"), F.sum("d").alias("total"))


@R.add("rps", f"WITH {S} SELECT workload, round(CASE WHEN sum(d) > 0 THEN count(*) / (sum(d) / 1000.0) ELSE 0 END, 6) AS rps FROM s GROUP BY workload")
def rps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("workload").agg(F.round(F.coalesce(F.try_divide(F.count("*"), F.sum("d") / 1000.0), F.lit(0.0)), 6).alias("rps"))


@R.add("median_row", f"WITH {S}, k AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY d, run) AS k, count(*) OVER (PARTITION BY workload) AS n FROM s) SELECT workload, d, user_id AS backoff, run AS active FROM k WHERE k = (n + 1) // 2")
def median_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of the run with the median duration, all from that run."""
    return stats.median_row(samples(spark, sf_dir), "workload", "d", "run").select("workload", "d", F.col("user_id").alias("backoff"), F.col("run").alias("active"))


@R.add("cliffs_delta", f"WITH {S}, {AB}, x AS (SELECT a.workload, avg(sign(a.d - b.d)) AS delta FROM ab a JOIN ab b ON a.workload = b.workload AND a.tool = 'a' AND b.tool = 'b' GROUP BY 1) SELECT workload, round(delta, 9) AS delta, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM x")
def cliffs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tools(spark, sf_dir)
    return stats.cliffs_delta(rows.where("tool = 'a'"), rows.where("tool = 'b'"), "workload", "d")


@R.add("pairwise_all", f"WITH {S}, {AB}, m AS (SELECT workload, tool, floor(median(d))::BIGINT AS m FROM ab GROUP BY 1, 2) SELECT a.workload, a.tool AS base, b.tool AS other, a.m AS base_median, b.m AS other_median, round(a.m / b.m, 9) AS ratio, a.m - b.m AS diff FROM m a JOIN m b ON a.workload = b.workload WHERE a.tool = 'a' AND b.tool <> a.tool")
def pairwise_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tools(spark, sf_dir).groupBy("workload", "tool").agg(stats.averaged_median("d").alias("m"))
    base, other = m.where("tool = 'a'").alias("x"), m.where("tool <> 'a'").alias("y")
    j = base.join(other, F.col("x.workload") == F.col("y.workload"))
    return j.select("x.workload", F.col("x.tool").alias("base"), F.col("y.tool").alias("other"), F.col("x.m").alias("base_median"), F.col("y.m").alias("other_median"), F.round(F.col("x.m") / F.col("y.m"), 9).alias("ratio"), (F.col("x.m") - F.col("y.m")).alias("diff"))


def _u(k: int) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', '1', workload, tool, r, '{k}')), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def _gamma(k: str, i: int) -> str:
    return f"CASE WHEN {k} = 1 THEN -ln({_u(i)}) ELSE {k} * pow(greatest(1 - 1 / (9 * {k}) + sqrt(-2 * ln({_u(i)})) * cos(2 * pi() * {_u(i + 1)}) / (3 * sqrt({k})), 0.001), 3) END"


BOOT = (
    f"WITH {S}, {AB}, c AS (SELECT workload, tool, d, count(*) AS c, sum(count(*)) OVER (PARTITION BY workload, tool ORDER BY d) AS upto FROM ab GROUP BY 1, 2, 3), "
    "k AS (SELECT workload, tool, count(*)::DOUBLE AS n, floor((count(*) + 1) / 2)::DOUBLE AS m FROM ab GROUP BY 1, 2), q AS (SELECT *, unnest(range(2000)) AS r FROM k), "
    f"g AS (SELECT *, {_gamma('m', 1)} AS g1, {_gamma('(n - m + 1)', 3)} AS g2 FROM q), u AS (SELECT *, g1 / (g1 + g2) AS u FROM g), "
    f"i AS (SELECT workload, tool, r, least(n, floor(n * unnest([u, CASE WHEN n % 2 = 0 THEN u + (1 - u) * (1 - pow({_u(5)}, 1 / (n - m))) ELSE u END])) + 1) AS rank FROM u), "
    "x AS (SELECT i.workload, i.tool, r, floor(sum(d) / 2) AS x FROM i JOIN c ON c.workload = i.workload AND c.tool = i.tool AND c.upto >= rank AND c.upto - c.c < rank GROUP BY 1, 2, 3), "
    "y AS (SELECT a.workload, list_sort(list(a.x - b.x)) AS s FROM x a JOIN x b ON a.workload = b.workload AND a.r = b.r AND a.tool = 'a' AND b.tool = 'b' GROUP BY 1), "
    "ci AS (SELECT workload, s[51]::BIGINT AS ci_low, s[1951]::BIGINT AS ci_high FROM y)"
)


@R.add("bootstrap_ci", f"{BOOT} SELECT * FROM ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals over all runs of each tool."""
    return stats.bootstrap_ci(tools(spark, sf_dir), "workload", "tool", "d")


MADS = "m AS (SELECT workload, tool, floor(median(d))::BIGINT AS m, quantile_disc(d, 0.5) AS q FROM ab GROUP BY 1, 2), v AS (SELECT ab.workload, ab.tool, quantile_disc(abs(d - q), 0.5) AS mad FROM ab JOIN m USING (workload, tool) GROUP BY 1, 2)"


@R.add("pairwise_significance", f"{BOOT}, {MADS} SELECT a.workload, abs(a.m - b.m) > va.mad + vb.mad AS apart, (ci_low > 0 OR ci_high < 0) AND abs(a.m - b.m) > va.mad + vb.mad AS significant FROM m a JOIN m b ON a.workload = b.workload AND a.tool = 'a' AND b.tool = 'b' JOIN v va ON va.workload = a.workload AND va.tool = 'a' JOIN v vb ON vb.workload = a.workload AND vb.tool = 'b' JOIN ci ON ci.workload = a.workload")
def pairwise_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the medians lie further apart than both deviations together, and whether the interval of their difference excludes 0 as well."""
    rows = tools(spark, sf_dir).withColumn("key", F.struct("workload", "tool"))
    m = rows.groupBy("key").agg(stats.averaged_median("d").alias("m")).join(stats.mad(rows, "key", "d"), "key")
    side = lambda t: m.where(F.col("key.tool") == t).select(F.col("key.workload").alias("workload"), F.col("m").alias(f"m_{t}"), F.col("mad").alias(f"mad_{t}"))
    apart = F.abs(F.col("m_b") - F.col("m_a")) > F.col("mad_a") + F.col("mad_b")
    both = side("a").join(side("b"), "workload").join(bootstrap_ci(spark, sf_dir), "workload")
    return both.select("workload", apart.alias("apart"), (((F.col("ci_low") > 0) | (F.col("ci_high") < 0)) & apart).alias("significant"))


# Verdicts: a run of a workload (an order's lines) passes if nothing was returned.
V = "v AS (SELECT l_orderkey % 50 AS workload, l_linenumber AS run, l_orderkey AS k, l_returnflag <> 'R' AS passed, concat('requests:', l_returnflag, l_linestatus) AS diff FROM lineitem)"


@R.add("flaky_verdict", f"WITH {V}, f AS (SELECT *, CASE WHEN NOT passed THEN row_number() OVER (PARTITION BY workload, passed ORDER BY k, run, diff) END AS r FROM v) SELECT workload, count(*) AS runs, count(*) FILTER (passed) AS passes, CASE WHEN bool_and(passed) THEN 'PASS' WHEN bool_or(passed) THEN 'FLAKY' ELSE 'FAIL' END AS verdict, coalesce(string_agg(diff, ';' ORDER BY k, run, diff) FILTER (r <= 3), '') AS diffs FROM f GROUP BY workload")
def flaky_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("workload"), F.col("l_linenumber").alias("run"), F.col("l_orderkey").alias("k"), (F.col("l_returnflag") != "R").alias("passed"), F.concat(F.lit("requests:"), "l_returnflag", "l_linestatus").alias("diff"))
    ranked = rows.withColumn("r", F.when(~F.col("passed"), F.row_number().over(Window.partitionBy("workload", "passed").orderBy("k", "run", "diff"))))
    verdict = F.when(F.bool_and("passed"), "PASS").when(F.bool_or("passed"), "FLAKY").otherwise("FAIL")
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("k", "run", "diff")))), lambda x: x["diff"]), ";")
    return ranked.groupBy("workload").agg(F.count("*").alias("runs"), F.count_if("passed").alias("passes"), verdict.alias("verdict"), first.alias("diffs"))


TOOL = "t AS (SELECT l_suppkey % 4 AS tool, l_partkey % 40 AS workload, l_orderkey AS run, CAST(l_quantity AS BIGINT) AS found, 50 AS total, l_quantity > 5 AS passed, CASE WHEN l_linenumber < 7 THEN CAST(l_extendedprice AS BIGINT) END AS rss FROM lineitem)"


def tool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    rss = F.when(F.col("l_linenumber") < 7, F.round("l_extendedprice").cast("bigint"))
    return rows.select((F.col("l_suppkey") % 4).alias("tool"), (F.col("l_partkey") % 40).alias("workload"), F.col("l_orderkey").alias("run"), F.col("l_quantity").cast("bigint").alias("found"), F.lit(50).alias("total"), (F.col("l_quantity") > 5).alias("passed"), rss.alias("rss"))


@R.add("tool_verdict", f"WITH {TOOL} SELECT tool, workload, CASE WHEN count(*) = 0 THEN 'UNAVAILABLE' WHEN bool_and(passed) THEN 'PASS' WHEN bool_or(passed) THEN 'FLAKY' ELSE 'FAIL' END AS verdict, min(found) AS min_found, max(found) AS max_found, bool_and(rss IS NOT NULL) AS rss_available FROM t GROUP BY 1, 2")
def tool_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.bool_and("passed"), "PASS").when(F.bool_or("passed"), "FLAKY").otherwise("FAIL")
    return tool_rows(spark, sf_dir).groupBy("tool", "workload").agg(verdict.alias("verdict"), F.min("found").alias("min_found"), F.max("found").alias("max_found"), F.bool_and(F.col("rss").isNotNull()).alias("rss_available"))


@R.add("tool_rollup", f"WITH {TOOL}, w AS (SELECT tool, workload, bool_and(passed) AS perfect, max(found) AS covered, max(total) AS total, quantile_disc(found, 0.5) AS med FROM t GROUP BY 1, 2) SELECT tool, count(*) FILTER (perfect) AS perfect, count(*) AS tested, sum(covered)::BIGINT AS covered, sum(total)::BIGINT AS total, sum(total - covered)::BIGINT AS missing, quantile_disc(med, 0.5) AS median FROM w GROUP BY tool")
def tool_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tool_rows(spark, sf_dir).groupBy("tool", "workload").agg(F.bool_and("passed").alias("perfect"), F.max("found").alias("covered"), F.max("total").alias("total"), stats.nearest_rank("found", 0.5).alias("med"))
    return w.groupBy("tool").agg(F.count_if("perfect").alias("perfect"), F.count("*").alias("tested"), F.sum("covered").alias("covered"), F.sum("total").alias("total"), F.sum(F.col("total") - F.col("covered")).alias("missing"), stats.nearest_rank("med", 0.5).alias("median"))


@R.add("recall", f"WITH {TOOL} SELECT tool, round(coalesce(100.0 * sum(found) / nullif(sum(total), 0), 0), 6) AS recall FROM t GROUP BY tool")
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_rows(spark, sf_dir).groupBy("tool").agg(F.round(F.coalesce(F.try_divide(F.sum("found") * 100.0, F.sum("total")), F.lit(0.0)), 6).alias("recall"))


@R.add("missing_paths", "WITH r AS (SELECT l_suppkey AS tool, l_orderkey AS run, list_sort(list_distinct(list(concat('/p/', l_partkey % 5)))) AS miss FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT tool, count(*) AS failing, array_to_string(list_sort(list_distinct(flatten(list(miss)))), ' ') AS missing, count(DISTINCT array_to_string(miss, ' ')) = 1 AS always_same FROM r GROUP BY tool")
def missing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("tool"), F.col("l_orderkey").alias("run"), F.concat(F.lit("/p/"), (F.col("l_partkey") % 5).cast("string")).alias("path"))
    runs = rows.groupBy("tool", "run").agg(F.array_sort(F.collect_set("path")).alias("miss"))
    union = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("miss")))), " ")
    return runs.groupBy("tool").agg(F.count("*").alias("failing"), union.alias("missing"), (F.count_distinct("miss") == 1).alias("always_same"))


# Scales: a supplier's yearly sums as points of a family.
P = "p AS (SELECT l_suppkey % 8 AS family, CAST(100 * pow(10, l_linenumber % 4) AS BIGINT) AS scale, CAST(sum(l_quantity) AS BIGINT) AS value, CAST(sum(l_partkey) AS BIGINT) AS rss FROM lineitem GROUP BY 1, 2)"
E_ = "e AS (SELECT *, max(CASE WHEN value > 3000 AND scale >= 100000 THEN 1 ELSE 0 END) OVER (PARTITION BY family ORDER BY scale ROWS UNBOUNDED PRECEDING) = 1 AS excluded FROM p)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("family"), (100 * F.pow(F.lit(10.0), F.col("l_linenumber") % 4)).cast("bigint").alias("scale"))
    rows = rows.agg(F.sum("l_quantity").cast("bigint").alias("value"), F.sum("l_partkey").alias("rss"))
    return stats.exclusion_cascade(rows, (F.col("value") > 3000) & (F.col("scale") >= 100000))


@R.add("exclusion_cascade", f"WITH {P}, {E_} SELECT family, scale, value, excluded FROM e")
def exclusion_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("family", "scale", "value", "excluded")


LAGS = f"WITH {P}, {E_}, g AS (SELECT family, scale, value, rss, lag(scale) OVER w AS sb, lag(value) OVER w AS vb, lag(rss) OVER w AS rb FROM e WHERE NOT excluded WINDOW w AS (PARTITION BY family ORDER BY scale))"


@R.add("scaling_ratios", f"{LAGS} SELECT family, sb AS scale_before, scale, round(scale / sb, 9) AS scale_ratio, round(value / vb, 9) AS ratio, CASE WHEN (value / vb) / (scale / sb) < 0.75 THEN 'sub-linear' WHEN (value / vb) / (scale / sb) > 1.25 THEN 'super-linear' ELSE 'roughly linear' END AS class FROM g WHERE sb IS NOT NULL")
def scaling_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.scaling_ratios(points(spark, sf_dir))


@R.add("classify_ratio", f"{LAGS} SELECT family, scale, CASE WHEN (rss / rb) / (scale / sb) < 0.75 THEN 'sub-linear' WHEN (rss / rb) / (scale / sb) > 1.25 THEN 'super-linear' ELSE 'roughly linear' END AS class FROM g WHERE sb IS NOT NULL")
def classify_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.scaling_ratios(points(spark, sf_dir).select("family", "scale", F.col("rss").alias("value"), "excluded")).select("family", "scale", "class")


@R.add("delta_rss_per_1000", f"{LAGS} SELECT family, scale, round((rss - rb) * 1000.0 / (scale - sb), 6) AS delta FROM g WHERE sb IS NOT NULL")
def delta_rss_per_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("family").orderBy("scale")
    rows = points(spark, sf_dir).where("not excluded").withColumns({"sb": F.lag("scale").over(w), "rb": F.lag("rss").over(w)}).where("sb is not null")
    return rows.select("family", "scale", F.round((F.col("rss") - F.col("rb")) * 1000.0 / (F.col("scale") - F.col("sb")), 6).alias("delta"))


@R.add("same_scale_ratio", f"WITH {P} SELECT a.family AS a, b.family AS b, a.scale, round(a.value / b.value, 9) AS ratio FROM p a JOIN p b ON a.scale = b.scale AND a.family < b.family")
def same_scale_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    j = p.alias("x").join(p.alias("y"), (F.col("x.scale") == F.col("y.scale")) & (F.col("x.family") < F.col("y.family")))
    return j.select(F.col("x.family").alias("a"), F.col("y.family").alias("b"), F.col("x.scale").alias("scale"), F.round(F.col("x.value") / F.col("y.value"), 9).alias("ratio"))


TIERS = [(30, 5), (15, 3), (5, 2), (3, 1)]


@R.add("run_tiers", f"WITH {P}, k AS (SELECT family, scale, least(row_number() OVER (PARTITION BY family ORDER BY scale), {len(TIERS)}) AS k FROM p) SELECT family, scale, [{', '.join(str(a) for a, _ in TIERS)}][k]::INTEGER AS runs, [{', '.join(str(b) for _, b in TIERS)}][k]::INTEGER AS warmups FROM k")
def run_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.least(F.row_number().over(Window.partitionBy("family").orderBy("scale")), F.lit(len(TIERS))) - 1
    pick = lambda n: F.get(F.array(*[F.lit(t[n]) for t in TIERS]), k)
    return points(spark, sf_dir).select("family", "scale", pick(0).alias("runs"), pick(1).alias("warmups"))


@R.add("scale_label", "SELECT o_orderkey AS k, n, CASE WHEN n >= 1000000 AND n % 1000000 = 0 THEN concat(n // 1000000, 'm') WHEN n >= 1000 AND n % 1000 = 0 THEN concat(n // 1000, 'k') ELSE CAST(n AS VARCHAR) END AS label FROM (SELECT o_orderkey, o_orderkey * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END) AS n FROM orders)")
def scale_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = k * F.when(k % 3 == 0, 1).when(k % 3 == 1, 1000).otherwise(1000000)
    return table(spark, sf_dir, "orders").select(k.alias("k"), n.alias("n")).withColumn("label", policy.scale_label(F.col("n")))


@R.add("human_bytes", "SELECT o_orderkey AS k, CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE concat(n, ' B') END AS shown FROM (SELECT o_orderkey, o_orderkey * 37 AS n FROM orders)")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), policy.human_bytes(F.col("o_orderkey") * 37).alias("shown"))


REPETITIONS = 5


@R.add("interleave_order", f"WITH {TOOL}, w AS (SELECT DISTINCT workload, tool FROM t), r AS (SELECT *, unnest(range({REPETITIONS})) AS repetition FROM w) SELECT workload, repetition::INTEGER AS repetition, tool, row_number() OVER (PARTITION BY workload, repetition ORDER BY md5(concat_ws('|', '7', workload, repetition, tool)), tool)::INTEGER AS position FROM r")
def interleave_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each repetition of a workload the tools in an order of its own, which a seed fixes."""
    rows = tool_rows(spark, sf_dir).select("workload", "tool").distinct().withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(REPETITIONS - 1))))
    names = [F.col(c).cast("string") for c in ("workload", "repetition", "tool")]
    w = Window.partitionBy("workload", "repetition").orderBy(F.md5(F.concat_ws("|", F.lit("7"), *names)), "tool")
    return rows.withColumn("position", F.row_number().over(w))


QUERIES, ORACLES = R.queries, R.oracles
