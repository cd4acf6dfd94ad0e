"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct five-word shingles. Signatures have CHUNKS chunks of CHUNK
16-bit symbols. By the pigeonhole principle two signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 symbols have a chunk with at most ERRORS errors; enumerating the chunk
with each choice of ERRORS symbols masked puts the two under one key, so every such pair meets.
Pairs that meet are filtered by the distance of longer signatures and confirmed on full sets.

Only connectivity is asked for, so a bucket is not expanded into all its pairs: first each member
meets the bucket's smallest. Members that are then in different components are compared by signature, in
blocks that give a forest over the near ones. What the forests join is at last compared on full sets,
again in blocks, and each block gives a forest of links; so rows grow with members, not with pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.llm.common import attach, bounded, components, drop_table, map_batches, table, written
from pagegraph.llm.shingles import mixed, shingle_sets, signatures

CHUNKS, CHUNK, ERRORS = 12, 4, 1
#: Symbols of the longer signature (8 bits each) and the least that a pair of similarity 0.75 has equal: its mean less 4.5 deviations.
FULL, EQUAL = 192, 117
#: The same for the first 48 of them, asked for first.
EQUAL_FIRST = 21
#: Documents of a bucket whose signatures are compared at once.
BLOCK = 2048
#: Documents, and shingles, whose full sets are compared at once with as many others.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 18
PERCENT = 75


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """Rows of 16-bit symbols to rows of keys: for each chunk, the chunk with each choice of ERRORS symbols masked."""
    keys = []
    for c in range(CHUNKS):
        for kept in combinations(range(CHUNK), CHUNK - ERRORS):
            key = np.full(len(symbols), (c + 1) * 1000 + sum(1 << i for i in kept), np.uint64)
            for i in kept:
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + symbols[:, c * CHUNK + i].astype(np.uint64))
            keys.append(key)
    return np.stack(keys, 1).view(np.int64)


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, fp (a 128-bit digest of the set; null if empty) and sig."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, sets = batch.column(0), shingle_sets(batch.column(1).to_pylist())
        full = [k for k, s in enumerate(sets) if len(s)]
        sigs: list[bytes | None] = [None] * len(sets)
        if full:
            rows = signatures([sets[k] for k in full], FULL)
            keyed = (rows[:, : CHUNKS * CHUNK] & np.uint32(0xFFFF)).astype("<u2")
            short = (rows >> np.uint32(16)).astype(np.uint8)
            for k, x, y in zip(full, keyed, short, strict=True):
                sigs[k] = x.tobytes() + y.tobytes()
        fps = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield pa.record_batch([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "fp", "sig"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, n_shingles long, fp binary, sig binary")


def exploded_keys(reps: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        symbols = np.stack([np.frombuffer(s[: 2 * CHUNKS * CHUNK], "<u2") for s in batch.column(1).to_pylist()])
        keys = chunk_keys(symbols)
        yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1]))], ["key", "id"])

    return map_batches(reps.select("id", "sig"), work, "key long, id long")


def close(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose long signatures are near enough and whose set sizes allow the similarity."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, y = (np.stack([np.frombuffer(s[2 * CHUNKS * CHUNK :], np.uint8) for s in batch.column(k).to_pylist()]) for k in (2, 3))
        keep = pa.array((x == y).sum(1) >= EQUAL)
        yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    one, two = (reps.select(F.col("id").alias(k), F.col("sig").alias(f"sig_{k}"), F.col("n_shingles").alias(f"n_{k}")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b").where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return map_batches(both.select("a", "b", "sig_a", "sig_b"), work, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have the similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, np.ndarray] = {}
        for batch in batches:
            a, b, keep = batch.column(0), batch.column(1), []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if len(last) >= 64:
                    last.clear()
                for t in (ta, tb):
                    if t not in last:
                        last[t] = shingle_sets([t])[0]
                x, y = last[ta], last[tb]
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same > 0 and 100 * same >= PERCENT * (len(x) + len(y) - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([a.filter(keep), b.filter(keep)], ["a", "b"])

    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    # Both joins deal out the texts by doc_id, so that they are shuffled once; a side with one hot id is split by adaptive execution.
    both = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "tb"}), "b").join(texts.withColumnsRenamed({"doc_id": "a", "text": "ta"}), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(work, "a long, b long").distinct()


def by_group(rows: DataFrame, marks: list[str], compare: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Pairs (a, b) that `compare` gives for the rows of each group, ordered by side; the columns `marks` come first and name the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            a, b = compare(pa.Table.from_batches(held))
            if len(a):
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([batch.column(k).to_numpy() for k in range(len(marks))])
            edges = [0, *(np.flatnonzero((now[:, 1:] != now[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                mark = tuple(now[:, x].tolist())
                if mark != at and held:
                    yield from done()
                    held = []
                at = mark
                held.append(batch.slice(x, y - x))
        if held:
            yield from done()

    return rows.repartition(*marks).sortWithinPartitions(*marks, "side").mapInArrow(run, "a long, b long")


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph with this symmetric matrix: every node with a neighbour is in it."""
    parents, children = [], []
    seen = np.zeros(len(linked), bool)
    for start in np.flatnonzero(linked.any(0)).tolist():
        if seen[start]:
            continue
        seen[start] = True
        waiting = [start]
        while waiting:
            x = waiting.pop()
            fresh = np.flatnonzero(linked[x] & ~seen)
            seen[fresh] = True
            parents.append(np.full(len(fresh), x))
            children.append(fresh)
            waiting += fresh.tolist()
    none = np.zeros(0, np.int64)
    return np.concatenate(parents or [none]), np.concatenate(children or [none])


def apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, id, comp) of the buckets whose members are in several components."""
    now = members.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("comp"))
    now = written(now, "op6-members")
    mixed_keys = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    out = written(attach(now, mixed_keys, ["key"], ["id"], "inner"), "op6-mixed")
    drop_table(now)
    return out


def dealt(rows: DataFrame, group: str, docs: int, shingles: int | None = None) -> DataFrame:
    """Rows (group, id, comp, n_shingles, ...) of each group dealt into pairs of blocks (i, j), with their side there.

    In each group only members outside its commonest component (side 0) meet the others (side 1: all).
    A block holds about `docs` documents and `shingles` shingles, so that neither a group nor its pairs
    ever become rows of one task.
    """
    by_comp = rows.groupBy(group, "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w")).groupBy(group)
    common = by_comp.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "comp", "w")).alias("top"))
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(n / docs), F.ceil(w / shingles) if shingles else F.lit(1)).cast("int")
    sizes = common.select(group, F.col("top.comp").alias("top"), blocks(F.col("n"), F.col("w")).alias("all"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("few"))
    rows = attach(rows, sizes, [group], ["id"], "inner")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("bigint")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rows.where("comp <> top").withColumn("i", own("few")).withColumn("j", each("all")).withColumn("side", F.lit(0))
    two = rows.withColumn("j", own("all")).withColumn("i", each("few")).withColumn("side", F.lit(1))
    names = [group, "i", "j", "side", *[c for c in rows.columns if c not in (group, "top", "all", "few")]]
    return one.select(names).union(two.select(names))


def near_forest(members: DataFrame, reps: DataFrame) -> DataFrame:
    """For each bucket a forest (a, b) over the members that have a near signature in another component."""
    rows = members.select("key", "id", "comp").join(reps.select("id", "n_shingles", F.expr(f"substring(sig, {2 * CHUNKS * CHUNK + 1})").alias("sig")), "id")

    def compare(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side, ids, comp, n = (t.column(k).to_numpy() for k in ("side", "id", "comp", "n_shingles"))
        cut = int((side == 0).sum())
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), FULL)
        low, high = n * PERCENT, n * 100
        names, number = np.unique(ids, return_inverse=True)
        linked = np.zeros((len(names), len(names)), bool)
        for k in range(cut):
            may = np.flatnonzero((comp[cut:] != comp[k]) & (high[cut:] >= low[k]) & (high[k] >= low[cut:])) + cut
            if len(may):
                may = may[(sig[may, :48] == sig[k, :48]).sum(1) >= EQUAL_FIRST]
                hit = may[(sig[may] == sig[k]).sum(1) >= EQUAL]
                linked[number[k], number[hit]] = linked[number[hit], number[k]] = True
        a, b = forest(linked)
        return names[a], names[b]

    return by_group(dealt(rows, "key", BLOCK), ["key", "i", "j"], compare)


def shared_counts(one: list[np.ndarray], two: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """The sizes of the intersections of each of the sets `one` with each of `two` (64-bit hashes, each sorted, without repeats)."""
    sets = [*one, *two]
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    column = np.cumsum(np.concatenate(([True], flat[1:] != flat[:-1]))) - 1
    often = np.bincount(column) > 1  # a hash of one set is in no intersection
    keep = often[column]
    row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
    total = np.zeros((len(one), len(two)), np.float64)
    for at in range(0, int(often.sum()), width):  # columns are ordered, and so are slices of them
        x, y = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(sets), width), np.float32)
        part[row[x:y], column[x:y] - at] = 1
        total += part[: len(one)] @ part[len(one) :].T  # at most `width` in a slice: exact
    return total


def link_forest(near: DataFrame, reps: DataFrame, roots: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b), by full sets, between components: of those within a group of documents joined by near pairs, a forest for each two blocks."""
    nodes = near.select(F.col("node").alias("id"), F.col("root").alias("label")).union(near.select("root", "root")).distinct()
    nodes = nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("label", "id", F.coalesce("root", "id").alias("comp"))
    nodes = written(nodes.join(reps.select("id", "n_shingles"), "id"), "op6-near")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text")
    texts = texts.join(nodes.select("id"), "id").groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).drop("h")  # repeated rows once
    marks = ["label", "i", "j"]

    def compare(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side, ids, comp = (t.column(k).to_numpy() for k in ("side", "id", "comp"))
        cut = int((side == 0).sum())
        if not 0 < cut < len(ids):
            return ids[:0], ids[:0]
        sets = shingle_sets(t.column("text").to_pylist())
        n = np.array([len(s) for s in sets])
        same = shared_counts(sets[:cut], sets[cut:])
        link = (same > 0) & (100 * same >= PERCENT * (n[:cut, None] + n[None, cut:] - same)) & (comp[:cut, None] != comp[None, cut:])
        a, b = np.nonzero(link)
        b += cut
        names, number = np.unique(comp, return_inverse=True)
        which = np.full((len(names), len(names)), -1)  # of the links between two components one stands for all
        which[number[a], number[b]] = which[number[b], number[a]] = np.arange(len(a))
        k = which[forest(which >= 0)]
        return ids[a[k]], ids[b[k]]

    rows = dealt(nodes, "label", BLOCK_SETS, BLOCK_SHINGLES).join(texts, "id").select(*marks, "side", "id", "comp", "text")
    return by_group(rows, marks, compare)


def links(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Roots of the components of all links between representatives: (node, root)."""
    keys = exploded_keys(reps)
    # Buckets with the same members are one: most keys of a group give the same list.
    mark = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in range(2)]
    shared = keys.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n"), *mark).where("n > 1")
    shared = shared.groupBy("first", "n", "x0", "x1").agg(F.min("key").alias("key")).select("key", "first", "n")
    members = written(attach(keys, shared, ["key"], ["id"], "inner"), "op6-buckets")
    near = written(close(members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), reps), "op6-close")
    found = written(confirmed(near, docs), "op6-links")
    drop_table(near)
    roots = components(found)
    mixed_members = apart(members.where("n > 2"), roots)  # of two members all is known
    drop_table(members)
    near = written(near_forest(mixed_members, reps).distinct(), "op6-near-pairs")
    drop_table(mixed_members)
    if not near.isEmpty():
        found = found.union(written(link_forest(components(near), reps, roots, docs), "op6-links"))
        roots = components(found)
    drop_table(near)
    drop_table(found)
    return roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents (doc_id, text, ...).

    Null or wordless text: an empty set, linked with nothing. Rows that share a doc_id are one
    document whose links are those of all its rows. Null doc_id: the row gets the component of
    documents with the same set, null if there is none. Extra columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounded(docs.sparkSession)
    rows, labels = labelled(docs)
    out = attach(rows.select("doc_id", "n_shingles", "fp"), labels, ["fp"], [F.coalesce("doc_id", F.lit(0))])
    component: Column = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' profiles, and (fp, root) of each different set."""
    rows = written(profile(docs), "op6-profile")
    sets = rows.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    sets = written(sets, "op6-sets")
    roots = links(sets, docs)
    same = rows.where("fp is not null and doc_id is not null").groupBy("doc_id").agg(F.countDistinct("fp").alias("k")).where("k > 1").select("doc_id")
    if not same.isEmpty():  # a doc_id with several sets ties them together
        ties = rows.join(same, "doc_id", "left_semi").join(sets.select("fp", "id"), "fp").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
        roots = components(ties.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return rows, sets.select("fp", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("root", "id").alias("root"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (
  SELECT doc_id AS node, doc_id AS root FROM s
  UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = s.doc_id
"""

QUERIES = {"op6_neardup": op6_neardup}
ORACLES = {"op6_neardup": SQL}
