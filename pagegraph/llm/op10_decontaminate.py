"""Benchmark decontamination by template canonicalisation, from built-in functions.

Numbers, names and units of a text become typed placeholders that keep their value beside the type.
Windows of WINDOW template tokens (a shorter item is one window) are hashed and joined with those
of the benchmark items. A document holds an item if COVERED per cent of the item's windows, or RUN of
them, are found and the slots agree: every value of the item stands for one value in the
document, and most of them for one of their own, as in a question asked again with other numbers or names.
Slots are compared in each place where the item may stand, so other questions of the same stem do no harm.
Windows that stand in more than SHARED different items, such as a common prompt, tell nothing of one of
them and are not counted, unless an item has no others. Documents are first searched for word pairs of
which every held item shows one, so that few templates are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagegraph.llm.common import attach, table, written

WINDOW, COVERED, RUN = 8, 50, 12
#: Per cent of an item's slot values that may stand for several values, and that may have no value of their own.
CONFLICTS, MERGED = 20, 50
#: Different item texts that may hold a window that counts.
SHARED = 20
#: Benchmark windows up to which they are broadcast (under 10 MB); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Word pairs up to which documents are first searched for them.
SEARCHED = 20_000

NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"
#: What parts tokens: anything but letters, marks, digits and placeholders.
OTHER = "[^\\p{L}\\p{M}\\p{N}\ue001-\ue004]+"
UNITS = "km|m|cm|mm|kg|g|mg|lbs?|oz|l|ml|mph|kmh|miles?|feet|foot|ft|inch(?:es)?|hours?|hrs?|h|minutes?|mins?|seconds?|secs?|s|days?|weeks?|months?|years?|dollars?|euros?|pounds?|cents?|percent|degrees?"
CURRENCIES = {"$": "dollar", "€": "euro", "£": "pound", "¥": "yen"}
#: Words that open sentences and are no names.
STARTERS = (
    "A About After All Also Although An And Answer Any Are As At Because Before Both But By Calculate Can Compute Consider Could Did Do Does During Each Every "
    "Explain Few Find For From Given Had Has Have He Her Here His How However I If In Into Is It Its Let Many Most My No Not Now Of On Once One Only Or Our "
    "Over Question She Should Since So Some Suppose Than That The Their Then There These They This Those To Two Under Until Was We Were What When Where "
    "Which While Who Whose Why Will With Without Would You Your"
)


def tokens(text: Column) -> Column:
    """Lower-case tokens without punctuation; a placeholder is its type's character and the value behind it."""
    end = "(?![\\p{L}\\p{M}\\p{N}])"
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "[\ue001-\ue004]", " ")
    # A capitalised word is a name, wherever it stands, unless it is one that opens sentences.
    text = F.regexp_replace(text, f"(?=\\p{{Lu}})(?<![\\p{{L}}\\p{{M}}\\p{{N}}])(?!(?:{STARTERS.replace(' ', '|')}){end})\\p{{Lu}}\\p{{Ll}}+{end}", f"{NAME}$0")
    text = F.regexp_replace(text, f" (?<={NAME}\\p{{L}}{{2,40}} ){NAME}", "\ue004")  # names of several words are one slot
    numbered = F.regexp_replace(text, f"[0-9](?<![\\p{{L}}\\p{{N}}].)([0-9]*(?:[.,:/][0-9]+)*)(?=(?:{UNITS})?{end})", f" {NUMBER}$0 ")
    numbered = F.regexp_replace(numbered, f"(\\G(?!\\A)|{NUMBER})([0-9]+)[.,:/](?=[0-9])", "$1$2\ue004")  # what parts a number's digits parts no tokens
    # A unit stands behind its number, however it is written: 5 km, 5km, 20%, $5. Its plural is the same unit.
    numbered = F.regexp_replace(numbered, f"({NUMBER}\\S+\\s+)({UNITS}){end}", f"$1{UNIT}$2")
    numbered = F.regexp_replace(numbered, f"({UNIT}\\p{{L}}{{2,}})s{end}", "$1")
    numbered = F.regexp_replace(numbered, f"({NUMBER}\\S+\\s+)%", f"$1{UNIT}percent ")
    for sign, name in CURRENCIES.items():
        numbered = F.regexp_replace(numbered, f"[{sign}]\\s*({NUMBER}\\S+)", f"$1 {UNIT}{name} ")
    text = F.when(text.rlike("[0-9]"), numbered).otherwise(text)
    return F.array_remove(F.split(F.lower(text), OTHER), "")


def with_windows(rows: DataFrame, text: str, keep: list[str], widths: list[int], keys_too: bool = False) -> DataFrame:
    """keep and, for each window of each row, h, pos, slots (its placeholders with values, in order) and on demand best.

    best is what a text with the window also has: its longest pair of neighbouring words of letters (kind 2), else
    its longest word (kind 1), else null. A window of placeholders only is hashed with their values.
    """
    rows = rows.select(*keep, tokens(F.col(text)).alias("v"))
    slot = lambda x: (x >= NUMBER) & (x < "\ue004")  # noqa: E731  starts with a placeholder
    rows = rows.withColumn("s", F.transform("v", slot)).withColumn("h", F.transform("v", lambda x: F.when(slot(x), F.xxhash64(F.substring(x, 1, 1))).otherwise(F.xxhash64(x))))

    def windows(k: int) -> Column:
        def one(i: Column) -> Column:
            any_slot = reduce(lambda a, b: a | b, [F.get("s", i + j) for j in range(k)])
            all_slots = reduce(lambda a, b: a & b, [F.get("s", i + j) for j in range(k)])
            slots = F.array_join(F.filter(F.array(*[F.get("v", i + j) for j in range(k)]), slot), " ")
            at = lambda j: F.get("v", i + j)
            letters = lambda j: at(j).rlike("^[\\p{L}\\p{M}]+$")
            key = lambda kind, n, *x: F.struct(F.lit(kind).alias("kind"), n.alias("n"), F.xxhash64(*x).alias("x"))
            words = [F.when(letters(j), key(1, F.length(at(j)), at(j))) for j in range(k)]
            words += [F.when(letters(j) & letters(j + 1), key(2, F.length(at(j)) + F.length(at(j + 1)), at(j), at(j + 1))) for j in range(k - 1)]
            best = [F.array_max(F.array(*words)).alias("best")] if keys_too else []
            types = F.xxhash64(F.lit(k), *[F.get("h", i + j) for j in range(k)])
            h = F.when(all_slots, F.xxhash64(types, *[at(j) for j in range(k)])).otherwise(types)
            return F.struct(h.alias("h"), i.alias("pos"), F.when(any_slot, slots).otherwise("").alias("slots"), *best)

        none = F.array().cast("array<struct<h:bigint,pos:int,slots:string" + ",best:struct<kind:int,n:int,x:bigint>" * keys_too + ">>")
        return F.when(F.size("v") >= k, F.transform(F.sequence(F.lit(0), F.size("v") - k), one)).otherwise(none)

    return rows.select(*keep, F.inline(F.concat(*[windows(k) for k in widths])))


def counted(grams: DataFrame) -> DataFrame:
    """The windows that count: those of at most SHARED item texts, and all of an item text that has no such."""
    often = grams.groupBy("h").agg(F.countDistinct("tid").alias("n")).where(F.col("n") > SHARED).select("h", F.lit(True).alias("often"))
    marked = attach(grams, often, ["h"], ["tid"]).withColumn("rare", F.col("often").isNull())
    some = marked.where("rare").select("tid").distinct().withColumn("some", F.lit(True))
    return marked.join(some, "tid", "left").where(F.col("rare") | F.col("some").isNull()).drop("often", "rare", "some")


def searched(docs: DataFrame, sought: DataFrame) -> DataFrame:
    """docs (text, ...) that show one of the keys; all of them if there are more than SEARCHED, or one is null."""
    keys = [(r.kind, r.x) for r in sought.select("kind", "x").distinct().limit(SEARCHED + 1).collect()]
    if not 0 < len(keys) <= SEARCHED or (None, None) in keys:
        return docs
    literal = lambda kind: F.split(F.lit(",".join(str(x) for k, x in keys if k == kind)), ",").cast("array<bigint>")  # noqa: E731  one literal
    kinds = {k for k, _ in keys}
    pair = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - 2)), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
    tests = {2: lambda w: F.arrays_overlap(pair(w), literal(2)), 1: lambda w: F.arrays_overlap(F.transform(w, lambda x: F.xxhash64(x)), literal(1))}
    shows = lambda w: reduce(lambda a, b: a | b, [tests[k](w) for k in kinds])
    # The words are a lambda's argument: as a column they would be split anew for each pair once the filter is pushed down.
    return docs.where(F.exists(F.array(F.split(F.lower("text"), "[^\\p{L}\\p{M}\\p{N}]+")), shows))


def leaks(docs: DataFrame, benchmark: DataFrame, covered: int = COVERED, run: int = RUN) -> DataFrame:
    """A row per document and benchmark item that it holds: doc_id, item_id, n_windows, n_matched, n_slots, n_conflicts.

    Null or empty texts hold nothing, and items without a token are held by nothing. Rows with the
    same doc_id, or without one, are reported together: they hold what one of them holds, or all of
    them as one. Items of one text are compared once and reported each. Of several places that hold an
    item the one with most windows is shown. Extra columns are not read.
    """
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("tid", F.xxhash64("text")).distinct()
    items = named.select("tid", "text", F.least(F.lit(WINDOW), F.size(tokens(F.col("text")))).alias("k")).where("k > 0").distinct()
    widths = sorted(r.k for r in items.select("k").distinct().collect())  # WINDOW values at most
    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long, n_matched long, n_slots long, n_conflicts long")
    grams = None
    for k in widths:
        part = with_windows(items.where(F.col("k") == k), "text", ["tid"], [k], keys_too=True)
        grams = part if grams is None else grams.union(part)
    grams = grams.select("tid", "h", F.col("pos").alias("ipos"), F.col("slots").alias("islots"), "best.kind", "best.x", F.coalesce("best.n", F.lit(0)).alias("size")).distinct()
    grams = written(counted(written(grams, "op10-all-grams")), "op10-grams")
    sizes = grams.groupBy("tid").agg(F.count("*").alias("n_windows"))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    # A held item shows `need` windows or more, so of all but need - 1 of its windows one is found: of those with the longest keys.
    need = F.least(F.ceil(F.col("n_windows") * covered / 100), F.lit(run))
    order = Window.partitionBy("tid").orderBy(F.desc_nulls_last("kind"), F.desc("size"), "x", "ipos", "h")
    sought = grams.join(sizes, "tid").withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("n_windows") - need + 1)
    found = with_windows(searched(docs, sought), "text", ["doc_id", "row"], widths)
    grams = grams.drop("kind", "x", "size")
    if grams.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hits = found.join(F.broadcast(grams), "h")
    else:  # a list has SHARED texts at most, besides those that have no window of their own
        per_hash = grams.groupBy("h").agg(F.collect_list(F.struct("tid", "ipos", "islots")).alias("items"))
        hits = attach(found, per_hash, ["h"], ["doc_id", "pos"], "inner").select("doc_id", "row", "pos", "slots", F.inline("items"))
    hits = written(hits.select("doc_id", "row", "tid", "ipos", "pos", "slots", "islots").distinct(), "op10-hits")
    # Ways to lay the item on the text: word for word, in climbing order with words put between, and by the first place of each window.
    w = Window.partitionBy("doc_id", "row", "tid").orderBy("pos", "ipos")
    hits = hits.withColumn("falls", F.coalesce(F.lag("ipos").over(w) >= F.col("ipos"), F.lit(False)).cast("long")).withColumn("climb", F.sum("falls").over(w))
    way = lambda kind, row, at: F.struct(F.lit(kind).alias("kind"), row.cast("long").alias("row"), at.cast("long").alias("at"))
    ways = F.array(way(0, F.lit(0), F.lit(0)), way(1, F.col("row"), F.col("pos") - F.col("ipos")), way(2, F.col("row"), F.col("climb")))
    hits = hits.withColumn("way", F.explode(ways)).groupBy("doc_id", "tid", "way", "ipos").agg(F.min(F.struct("pos", "slots", "islots")).alias("hit"))
    key = ["doc_id", "tid", "way"]
    counts = hits.groupBy(key).agg(F.count("*").alias("n_matched"))
    slots = hits.where("hit.slots <> ''").select(*key, F.inline(F.arrays_zip(F.split("hit.slots", " ").alias("mine"), F.split("hit.islots", " ").alias("theirs"))))
    slots = slots.groupBy(*key, "theirs").agg(F.min("mine").alias("lo"), F.max("mine").alias("hi"))
    slots = slots.groupBy(key).agg(F.count("*").alias("n_slots"), F.count_if(F.col("lo") < F.col("hi")).alias("n_conflicts"), F.countDistinct("lo").alias("n_values"))
    same = [counts[k].eqNullSafe(slots[k]) for k in key]
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = counts.join(slots, same, "left").select(counts["doc_id"], counts["tid"], "n_matched", zero("n_slots"), zero("n_conflicts"), zero("n_values"))
    enough = (100 * F.col("n_matched") >= covered * F.col("n_windows")) | (F.col("n_matched") >= run)
    agree = (100 * F.col("n_conflicts") <= CONFLICTS * F.col("n_slots")) & (100 * (F.col("n_slots") - F.col("n_values")) <= MERGED * F.col("n_slots"))
    held = out.join(sizes, "tid").where(enough & agree)
    best = F.max_by(F.struct("n_matched", "n_slots", "n_conflicts"), F.struct("n_matched", -F.col("n_conflicts"), "n_slots"))
    held = held.groupBy("doc_id", "tid", "n_windows").agg(best.alias("best")).join(named.select("item_id", "tid"), "tid")
    return held.select("doc_id", "item_id", "n_windows", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents that hold no benchmark item; same columns. Rows that share a doc_id, or have none, go together; texts that are null or empty stay."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_leaked"]), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLES: dict[str, str] = {}
