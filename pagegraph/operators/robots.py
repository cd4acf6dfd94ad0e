"""robots.txt files: rules by agent, and the gate that longest prefixes decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.functions.urls import decode_path, let


def rules(files: DataFrame) -> DataFrame:
    """(host, agent, ord, path, allow) of (host, body): groups of agents, each with the rules that follow it."""
    lines = files.select("host", F.posexplode(F.split("body", "\n")).alias("ord", "line"))
    lines = lines.select("host", "ord", F.btrim(F.regexp_replace("line", "#.*$", "")).alias("line")).where("line like '%:%'")
    lines = lines.select("host", "ord", F.lower(F.btrim(F.split("line", ":", 2)[0])).alias("key"), F.btrim(F.split("line", ":", 2)[1]).alias("value")).where("key in ('user-agent', 'allow', 'disallow')")
    w = Window.partitionBy("host").orderBy("ord")
    fresh = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    numbered = lines.withColumn("fresh", fresh).withColumn("part", F.sum(F.col("fresh").cast("int")).over(w))
    agents = numbered.where("key = 'user-agent'").select("host", "part", F.lower("value").alias("agent")).distinct()
    told = numbered.where("key <> 'user-agent' and value <> ''").select("host", "part", "ord", F.col("value").alias("path"), (F.col("key") == "allow").alias("allow"))
    return agents.join(told, ["host", "part"]).select("host", "agent", "ord", "path", "allow")


def allowed(urls: DataFrame, rule: DataFrame, agent: str) -> DataFrame:
    """Adds allowed to (id, host, path): the longest rule that starts the decoded path decides, allow wins ties, none allows.

    The rules of the agent's own group replace those of *. A host's rules are one array, so a URL stays one row; an
    empty path is /, and a path whose escapes are broken is taken as it stands.
    """
    mine = rule.where(F.col("agent").isin(agent.lower(), "*")).groupBy("host", "agent").agg(F.collect_set(F.struct("path", "allow")).alias("rules"))
    mine = mine.groupBy("host").agg(F.max_by("rules", F.col("agent") == agent.lower()).alias("rules"))  # a robots file is bounded, and so is a row
    decoded = F.coalesce(decode_path(F.col("path")), F.col("path"))
    path = F.when(F.coalesce(decoded, F.lit("")) == "", "/").otherwise(decoded)

    def best(at: Column) -> Column:
        fits = F.filter("rules", lambda r: at.startswith(r["path"]))
        return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))["allow"]

    return urls.join(mine, "host", "left").select("id", "host", "path", F.coalesce(let(path, best), F.lit(True)).alias("allowed"))
