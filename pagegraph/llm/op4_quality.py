"""Quality rules from built-in functions: base figures of each text, and cross-document line frequency.

A line is normalised (lower case, runs of blanks as one, numbers as 0) and hashed. For each host
(the column source) and line the different documents that hold it are counted. A line of more than
LIMIT documents is removed everywhere but in the document of the smallest doc_id that holds it, and a
document that loses more than LOST per cent of the words of its different lines is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.llm.common import attach, drop_table, table, written

BLANKS = "[\\x20\\x09-\\x0D]+"
LIMIT, LOST = 50, 70
MIN_WORDS, MAX_REPEATED = 50, 50
WINDOW = 3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def normal_lines(text: Column) -> Column:
    """A normalised line for each \\n-split line of the text, '' for one without a word."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "[\\x20\\x09\\x0B-\\x0D]+", " "), "[0-9]+", "0")
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))


def with_base(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with a column text."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("_words", words_of(text))
    docs = docs.withColumn("_windows", F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    # Windows found twice stand side by side once sorted. The hash set tells first whether there are any.
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(pairs))
    twice = F.filter("_sorted", lambda x, i: (x["h"] == F.get("_sorted", i + 1)["h"]) | ((i > 0) & (x["h"] == F.get("_sorted", F.greatest(i - 1, F.lit(0)))["h"])))
    docs = docs.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    docs = docs.withColumn("_lines", lines)
    docs = docs.select(
        *[c for c in docs.columns if c not in ("_words", "_windows", "_sorted", "_at", "_lines")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return docs.withColumn("base_failed", failed)


#: What names a row's document: its doc_id, or where it has none a hash of its text, and another hash of the text.
KEY = ["host", "no_id", "id", "fp"]


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, KEY and the columns `more`; a null text counts as empty."""
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), host.alias("host"), doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.xxhash64(F.lit(1), text)).alias("id"), F.xxhash64(text).alias("fp"), *more)


def removed_lines(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """For each document (KEY) that loses lines: their hashes and the words of these lines."""
    lines = F.filter(F.array_distinct(normal_lines(F.col("text"))), lambda x: x != "")  # of texts: of structs each is compared with each
    lines = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("w")))
    rows = keyed(docs).select(*KEY, F.explode(lines).alias("line")).select(*KEY, "line.h", "line.w")
    # One row per document and line, written once: it is counted and joined with the counts. Repeated rows are one.
    held = written(rows.groupBy("h", *KEY).agg(F.first("w").alias("w")), "op4-held")
    often = held.groupBy("host", "h").agg(F.count_distinct("no_id", "id").alias("n"), F.min(F.struct("no_id", "id")).alias("owner")).where(F.col("n") > limit)
    often = often.select("host", "h", F.col("owner.no_id").alias("own_no"), F.col("owner.id").alias("own_id"))
    lost = attach(held, often, ["host", "h"], ["id"], "inner").where("no_id <> own_no or id <> own_id")
    lost = written(lost.groupBy(*KEY).agg(F.collect_set("h").alias("lost"), F.sum("w").alias("lost_words")), "op4-lost")  # at most a document's own lines
    drop_table(held)
    return lost


def line_words(text: Column) -> Column:
    """Words of the different normalised lines."""
    lines = F.array_distinct(normal_lines(text))
    return F.aggregate(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.size(F.split(x, " "))), F.lit(0).cast("bigint"), lambda a, x: a + x)


def quality(docs: DataFrame, limit: int = LIMIT, lost: int = LOST) -> DataFrame:
    """One row per row of documents (doc_id, text, source): figures, base_failed, kept and what was lost.

    Null text: empty, so base_failed. Null source: the host ''. Repeated rows are one document. Rows that share
    a doc_id count as one document, and each loses its own lines; rows without are different documents
    if their texts are. Extra columns are not read.
    """
    base = with_base(keyed(docs)).withColumn("line_words", line_words(F.col("text")))
    removed = removed_lines(docs, limit)
    out = attach(base.drop("text"), removed.select(*KEY, "lost_words"), KEY, ["doc_id", "n_words"])
    lost_words = F.coalesce("lost_words", F.lit(0))
    depleted = (100 * lost_words > lost * F.col("line_words")) & (lost_words > 0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), lost_words.cast("long").alias("lost_words"))


def filtered(docs: DataFrame, limit: int = LIMIT, lost: int = LOST) -> DataFrame:
    """documents without the rejected ones and without the removed lines; same columns, n_chars made anew. Nulls and repeats as in quality()."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    base = with_base(keyed(docs.select("doc_id", "text", "source", row), "row")).withColumn("line_words", line_words(F.col("text")))
    # The generator keeps the filter above the figures; pushed below, it would make them anew for each word.
    # The text is dealt once, in its row, and only if the document is not rejected before.
    names = ["row", *KEY, "base_failed", "line_words"]
    base = base.select(F.inline(F.array(F.struct(*names)))).where("not base_failed").drop("base_failed")
    out = attach(base, removed_lines(docs, limit), KEY, ["line_words"])
    out = out.where(F.coalesce(F.col("lost_words"), F.lit(0)) * 100 <= lost * F.col("line_words")).withColumn("text", F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    zipped = F.arrays_zip(F.split("text", "\n").alias("line"), F.transform(normal_lines(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    left = F.array_join(F.transform(F.filter(zipped, lambda z: ~F.array_contains("lost", z["h"])), lambda z: z["line"]), "\n")
    out = out.withColumn("new", F.when(F.col("lost").isNull(), F.col("text")).otherwise(left))
    made = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return out.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
  list_transform(string_split(regexp_replace(regexp_replace(lower(t), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), chr(10)), lambda x: trim(x)) AS ns FROM d),
g AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, t, x, len(string_split(x, ' ')) AS nw FROM (SELECT doc_id, host, t, unnest(list_distinct(ns)) AS x FROM w) WHERE x <> ''),
o AS (SELECT host, x, min(doc_id) AS owner FROM l GROUP BY host, x HAVING count(DISTINCT doc_id) > {LIMIT}),
z AS (SELECT doc_id, sum(CASE WHEN o.x IS NOT NULL AND l.doc_id <> o.owner THEN nw ELSE 0 END)::BIGINT AS lost, sum(nw) AS total
  FROM l LEFT JOIN o ON l.host = o.host AND l.x = o.x GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM b)
SELECT f.*, NOT base_failed AND NOT (coalesce(lost, 0) > 0 AND 100 * coalesce(lost, 0) > {LOST} * total) AS kept, coalesce(lost, 0)::BIGINT AS lost_words
FROM f LEFT JOIN z ON z.doc_id = f.doc_id
"""

QUERIES = {"op4_quality": op4_quality}
ORACLES = {"op4_quality": SQL}
