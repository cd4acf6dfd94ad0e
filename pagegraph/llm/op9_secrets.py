"""Secret scans from built-in functions: three fixed patterns, and a randomness test battery.

Candidates of the battery are runs of ENCODED characters with a letter or a digit. Their encoding
is inferred from the characters; under it come a chi-squared test of uniformity over the alphabet, a
runs test above and below its middle, and a lag-one serial correlation. The p-values are combined by
Fisher's method. Within each class of length (powers of two) the Benjamini-Hochberg procedure at RATE
takes out the candidates that are structured. What is left is reported from the p-value on from which at most
RATE of it is estimated to be structured after all: random tokens have evenly spread p-values, as many above
one half as below, so what lies below in excess of that, by more than ERRORS standard errors, is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagegraph.functions.urls import let
from pagegraph.llm.common import table, written

#: Fixed patterns. Those of access and hex match only what is long enough: in a shorter run nothing else could match.
ASSIGN = "((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

ENCODED = "[A-Za-z0-9+/_-]{20,}={0,2}"
RATE = 0.05
#: Standard errors by which an excess has to show.
ERRORS = 2.0
#: Steps of -ln(p) in which p-values are counted; a step stands for its largest p, so the rate holds.
STEPS, LAST_STEP = 8, 800

#: Encodings in the order they are tried: pattern of the token, alphabet.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = [
    ("^[0-9]+$", DIGITS),
    ("^[a-z]+$", LOWER),
    ("^[A-Z]+$", UPPER),
    ("^[A-Za-z]+$", UPPER + LOWER),
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[a-z0-9]+$", DIGITS + LOWER),
    ("^[A-Z0-9]+$", DIGITS + UPPER),
    ("^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("", UPPER + LOWER + DIGITS + "+/-_"),
]

SPANS = "array<struct<start:bigint,end:bigint,part:string,value:string>>"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches, leftmost and non-overlapping: start and end in code points, the match, a group of it."""
    gaps, parts = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else parts
    zipped = F.arrays_zip(gaps.alias("gap"), parts.alias("part"), values.alias("value"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["part"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["part"].alias("part"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["part"].isNull(), a["out"]).otherwise(F.concat(a["out"], one)).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out"))
    none = F.array().cast(SPANS)
    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda a: a["out"])).otherwise(none)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def upper_tail(z: Column) -> Column:
    """P(normal > z) by a rational approximation (error below 1e-7), never 0."""

    def tail(x: Column) -> Column:
        k = F.lit(1.0) / (1 + 0.2316419 * F.abs(x))
        part = reduce(lambda a, c: (a + c) * k, (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.31938153), F.lit(0.0))
        above = F.exp(-x * x / 2) * 0.3989422804014327 * part
        return F.when(x < 0, 1 - above).otherwise(above)

    return let(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z)), tail)


def battery(token: Column) -> Column:
    """The combined p-value of a token under the hypothesis that it is random in its encoding."""
    body = F.rtrim(token, F.lit("="))
    alphabet = reduce(lambda rest, e: F.when(body.rlike(e[0]), F.lit(e[1])).otherwise(rest), reversed(ENCODINGS[:-1]), F.lit(ENCODINGS[-1][1]))
    # One element arrays stand for local names, so that nothing is computed twice.
    base = F.struct(F.length(body).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"), F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, alphabet).cast("double")).alias("codes"), body.alias("body"))

    def judged(b: Column) -> Column:
        n, k, codes = b["n"], b["k"], b["codes"]
        squares = total(F.transform(F.array_distinct(codes), lambda c: F.pow(F.size(F.filter(codes, lambda x: x == c)).cast("double"), F.lit(2.0))))
        # Mean and variance are exact however short the token is; the tail is that of the gamma distribution with both, by its cube root.
        shape = (k - 1) * n / (2 * (n - 1))
        chi = (F.pow(F.greatest((k / n * squares - n) / (k - 1), F.lit(1e-9)), F.lit(1.0 / 3)) - 1 + 1 / (9 * shape)) * 3 * F.sqrt(shape)
        high = total(F.transform(codes, lambda c: F.when(c > k / 2, 1.0).otherwise(0.0)))
        runs = total(F.transform(codes, lambda c, i: F.when((i > 0) & ((c > k / 2) != (F.get(codes, F.greatest(i - 1, F.lit(0))) > k / 2)), 1.0).otherwise(0.0))) + 1
        mean = 2 * high * (n - high) / n + 1
        spread = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
        zr = F.when(mean < 2.0, F.lit(8.0)).otherwise(F.abs(runs - mean) / F.sqrt(spread))
        mid = total(codes) / n
        around = F.greatest(total(F.transform(codes, lambda c: (c - mid) * (c - mid))), F.lit(1e-9))
        lag = total(F.transform(codes, lambda c, i: F.when(i > 0, (c - mid) * (F.get(codes, F.greatest(i - 1, F.lit(0))) - mid)).otherwise(0.0)))
        zs = F.abs(lag / around) * F.sqrt(n)
        half = -(F.ln(upper_tail(chi)) + F.ln(F.least(F.lit(1.0), 2 * upper_tail(zr))) + F.ln(F.least(F.lit(1.0), 2 * upper_tail(zs))))
        return F.exp(-half) * (1 + half + half * half / 2)

    return F.element_at(F.transform(F.array(base), judged), 1)


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, base (spans with the number of their kind) and candidates (spans with class of length and step of p)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(*keep, text.alias("_text"))
    assign = F.filter(found(F.col("_text"), ASSIGN, 2), lambda x: F.length(x["value"]) >= 6)
    parts = [assign, found(F.col("_text"), ACCESS), found(F.col("_text"), HEX)]
    numbered = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))
    base = F.sort_array(F.concat(*[F.transform(p, numbered(k)) for k, p in enumerate(parts)]))
    odd = F.filter(found(F.col("_text"), ENCODED), lambda x: x["part"].rlike("[0-9A-Za-z]"))
    docs = docs.select(*keep, base.alias("base"), odd.alias("odd"))
    new = F.filter("odd", lambda x: ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))
    step = lambda x: F.least(F.lit(LAST_STEP), F.floor(-F.ln(F.greatest(battery(x["part"]), F.lit(1e-300))) * STEPS)).cast("int")
    graded = F.transform(new, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.floor(F.log2((x["end"] - x["start"]).cast("double"))).cast("int").alias("class"), step(x).alias("step")))
    return docs.select(*keep, "base", graded.alias("candidates"))


def structured_from(rows: DataFrame) -> dict[int, int]:
    """For each class of length the step from which candidates are not reported.

    Candidates are counted by class and step, so at most 31 * (LAST_STEP + 1) counts are compared
    and at most 31 rows reach the driver, whatever the input.
    """
    counts = rows.select(F.explode("candidates").alias("c")).groupBy("c.class", "c.step").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("class")
    half = int(STEPS * 0.6931471805599453) + 1  # steps below it are p-values above one half, or nearly
    sums = {"rank": F.sum("n").over(by_class.orderBy(F.desc("step"))), "m": F.sum("n").over(by_class), "upto": F.sum("n").over(by_class.orderBy("step")), "upper": F.sum(F.when(F.col("step") < half, F.col("n")).otherwise(0)).over(by_class)}
    ranked = counts.withColumns(sums)
    rejected = F.exp(-F.col("step") / STEPS) <= RATE * F.col("rank") / F.col("m")
    share = F.exp(F.lit(-half / STEPS))  # p-values in the upper part lie above this
    random = F.col("upper") / (1 - share) * (1 - F.exp(-(F.col("step") + 1) / STEPS))
    fits = (F.col("upto") - random - ERRORS * F.sqrt("upto")) <= RATE * F.col("upto")
    out = ranked.groupBy("class").agg(F.min(F.when(rejected, F.col("step"))).alias("structured"), F.max(F.when(fits, F.col("step") + 1)).alias("doubtful"))
    return {r["class"]: min(LAST_STEP + 1 if r["structured"] is None else r["structured"], r["doubtful"] or 0) for r in out.collect()}


def with_spans(rows: DataFrame) -> DataFrame:
    """Adds spans (start, kind, end), base ones and random ones, in order."""
    limits = structured_from(rows)
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else F.lit(None).cast("map<int,int>")
    random = F.filter("candidates", lambda c: c["step"] < F.coalesce(F.try_element_at(limit, c["class"]), F.lit(0)))
    random = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return rows.withColumn("spans", F.sort_array(F.concat("base", random)))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """One row per row of documents (doc_id, text): counts and places of secrets.

    Null text: empty, no spans. Repeated rows, and rows without a doc_id, are each scanned. A random
    span inside a base span is left out. Extra columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = with_spans(written(scanned(docs, ["doc_id"]), "op9-scanned"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, mask: str = "<secret>") -> DataFrame:
    """documents with each secret replaced by `mask`; same columns, n_chars made anew.

    Spans that overlap are masked as one. Null text stays null, and rows without a doc_id or repeated ones are each
    masked. Texts are scanned once: rows are written with their spans, as the thresholds need all candidates first.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = with_spans(written(scanned(docs.select(row, "text"), ["row"]), "op9-scanned"))
    text = F.col("row.text").cast("string")
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        before = F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
        new = F.struct(x["end"].alias("at"), F.concat(a["out"], before, F.lit(mask)).alias("out"))
        return F.when(x["start"] >= a["at"], new).otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out")))

    whole = F.aggregate("spans", first, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    rows = rows.withColumn("new", F.when(F.size("spans") == 0, text).otherwise(whole))
    made = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return rows.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op9_secrets": op9_secrets}
ORACLES: dict[str, str] = {}
