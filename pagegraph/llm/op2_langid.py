"""Language of each word by a linear-chain conditional random field, and of each text by its words.

A word's features are its affixes and n-grams of one to three characters (with marks at both ends) and
itself, if the lexicon of the training sample has it. The field learns their weights and the
transitions between labels from sequences spliced of pieces of texts in several languages, so that it
labels code-switched text; marginals come from the forward-backward algorithm.

It is fitted on a bounded sample: SAMPLE labelled documents of each language at most and about TOTAL of all,
chosen by a hash, and PIECES pieces of PIECE words of each, cut where the documents are. Every text is then
labelled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagegraph.llm.common import map_batches, table

SAMPLE, TOTAL, PIECES, PIECE = 300, 60_000, 6, 25
#: Feature buckets, and weights at most (buckets times labels): with very many languages there are fewer buckets.
BUCKETS, WEIGHTS, ROUNDS, RATE, DECAY = 1 << 17, 1 << 24, 4, 0.2, 1e-6
#: Sequences of a training step and words of a sequence; lexicon words occur LEAST times or more.
BATCH, LENGTH, LEAST = 64, 50, 2
#: Characters of a word that is learned from at most; longer runs of letters are labelled only.
LONGEST = 100
#: Steps of a sequence whose marginals are held at once.
STEPS = 4096
#: Words whose features are held at once.
AT_ONCE = 10_000
#: Letters with the marks on them.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return WORD.findall(text.lower()) if text else []


def features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all features of the words, and where each word's begin; the last of each is the word itself."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    word = np.repeat(np.arange(len(words)), sizes)
    step = np.uint64(0x9E3779B97F4A7C15)
    grams, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, 5):  # three characters and, with a mark, affixes of three
        h = h[: len(codes) - n + 1] * step + codes[n - 1 :] + np.uint64(n)
        same = word[: len(h)] == word[n - 1 :]
        if n == 4:  # only those with a mark at an end
            same &= (codes[: len(h)] == 2) | (codes[n - 1 :] == 3)
        grams.append(h[same])
        owners.append(word[: len(h)][same])
    whole = np.add.reduceat(codes * (step ** (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.uint64)), starts)
    grams.append(whole ^ np.uint64(0xA5A5A5A5))
    owners.append(np.arange(len(words)))
    flat, owner = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    flat = flat[order]
    flat = (flat ^ (flat >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (flat >> np.uint64(32)).astype(np.int64) % buckets, np.searchsorted(owner[order], np.arange(len(words)))


def forward_backward(emit: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (time, batch, label) and expected transitions of padded sequences; mask (time, batch).

    emit holds log-potentials, move the logarithms of transition potentials.
    """
    times, batch, labels = emit.shape
    up = np.exp(emit - emit.max(2, keepdims=True))
    go = np.exp(move - move.max())
    alpha = np.empty_like(up)
    alpha[0] = up[0] / up[0].sum(1, keepdims=True)
    for t in range(1, times):
        a = (alpha[t - 1] @ go) * up[t]
        a /= a.sum(1, keepdims=True)
        alpha[t] = np.where(mask[t][:, None], a, alpha[t - 1])
    marginal, pairs = np.empty_like(up), np.zeros((labels, labels))
    beta = np.ones((batch, labels)) / labels
    for t in range(times - 1, -1, -1):
        g = alpha[t] * beta
        marginal[t] = g / g.sum(1, keepdims=True)
        if t:
            live = mask[t][:, None]
            x = up[t] * beta
            joint = alpha[t - 1][:, :, None] * go[None] * x[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True) * live[:, :, None]).sum(0)
            b = x @ go.T
            b /= b.sum(1, keepdims=True)
            beta = np.where(live, b, beta)
    return marginal, pairs


class Field:
    """Labels, weights of the buckets (a lexicon word shares one with no other use) and transitions."""

    def __init__(self, labels: list[str], weights: np.ndarray, move: np.ndarray, lexicon: set[str]) -> None:
        self.labels, self.weights, self.move, self.lexicon = labels, weights, move, lexicon

    def emissions(self, words: list[str]) -> np.ndarray:
        """The log-potentials of the labels of each word; features of AT_ONCE words are held at once."""
        return np.concatenate([self._emissions(words[k : k + AT_ONCE]) for k in range(0, len(words), AT_ONCE)])

    def _emissions(self, words: list[str]) -> np.ndarray:
        ids, starts = features(words, len(self.weights))
        out = np.add.reduceat(self.weights[ids], starts)
        ends = np.append(starts[1:], len(ids)) - 1  # the last feature is the word itself
        unknown = np.fromiter((w not in self.lexicon for w in words), bool, len(words))
        out[unknown] -= self.weights[ids[ends[unknown]]]
        return out

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each sequence of words the mean of its words' marginals."""
        index: dict[str, int] = {}
        number = index.setdefault
        coded = [np.fromiter((number(w, len(index)) for w in t), np.int32, len(t)) for t in texts]
        emit = self.emissions(list(index))
        out: list[np.ndarray] = [np.zeros(len(self.labels))] * len(texts)
        order = sorted(range(len(texts)), key=lambda k: len(coded[k]))
        while order:  # sequences of like length go together
            longest = len(coded[order[-1]])
            size = max(1, min(256, (1 << 20) // (min(longest, STEPS) * len(self.labels))))
            part, order = order[-size:], order[:-size]
            while len(part) > 1 and len(coded[part[0]]) * 2 < longest:
                order.append(part.pop(0))
            order.sort(key=lambda k: len(coded[k]))
            mask = np.zeros((longest, len(part)), bool)
            ids = np.zeros((longest, len(part)), np.int32)
            for c, k in enumerate(part):
                mask[: len(coded[k]), c] = True
                ids[: len(coded[k]), c] = coded[k]
            marginal = self.means(emit, ids, mask)
            for c, k in enumerate(part):
                out[k] = marginal[c]
        return out

    def means(self, emit: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The mean marginals (batch, label) of sequences of numbers of words; STEPS words are held at once."""
        up = np.exp(emit - emit.max(1, keepdims=True)).astype(np.float32)
        go = np.exp(self.move - self.move.max()).astype(np.float32)

        def forward(at: int, a: np.ndarray | None) -> np.ndarray:
            x = up[ids[at : at + STEPS]]
            alpha = np.empty_like(x)
            for t in range(len(x)):
                a = x[t] if a is None else (a @ go) * x[t]
                a = a / a.sum(1, keepdims=True)
                alpha[t] = a
            return alpha

        starts = range(0, len(ids), STEPS)
        before: list[np.ndarray | None] = [None]  # alpha ahead of each part
        alpha = None
        for at in starts:
            alpha = forward(at, before[-1])
            before.append(alpha[-1])
        total = np.zeros(alpha.shape[1:])
        beta = np.full(alpha.shape[1:], 1 / alpha.shape[2], np.float32)
        back = np.ascontiguousarray(go.T)
        for k, at in reversed(list(enumerate(starts))):
            if k < len(starts) - 1:
                alpha = forward(at, before[k])
            x = up[ids[at : at + STEPS]]
            for t in range(len(x) - 1, -1, -1):
                live = mask[at + t][:, None]
                g = alpha[t] * beta
                total += g / g.sum(1, keepdims=True) * live
                b = (x[t] * beta) @ back
                b /= b.sum(1, keepdims=True)
                beta = np.where(live, b, beta)
        return total / mask.sum(0)[:, None]


def pieces_of(text: str | None, pieces: int = PIECES) -> list[list[str]]:
    """At most `pieces` pieces of PIECE words of a text, chosen by the hash of their number; words over LONGEST characters are left out."""
    words = words_of(text)
    cuts = sorted(sorted(range(0, len(words), PIECE), key=lambda c: xxhash.xxh32_intdigest(str(c)))[:pieces])
    return [[w for w in words[c : c + PIECE] if len(w) <= LONGEST] for c in cuts]


def fit(samples: list[tuple[list[list[str]], str]], seed: int = 5) -> Field | None:
    """A field from (pieces, label) pairs; None without any word."""
    rng = np.random.default_rng(seed)
    labels = sorted({label for _, label in samples})
    number = {label: k for k, label in enumerate(labels)}
    pieces = [(p, number[label]) for some, label in samples for p in some if p]
    if not pieces:
        return None
    counts: dict[str, int] = {}
    for some, _ in pieces:
        for w in some:
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w for w, n in counts.items() if n >= LEAST}
    size = len(labels)
    buckets = min(BUCKETS, max(256, 1 << (WEIGHTS // size).bit_length() - 1))
    weights, seen = np.zeros((buckets, size)), np.full((buckets, 1), 1e-2)
    move, moved = np.zeros((size, size)), np.full((size, size), 1e-2)
    for _ in range(ROUNDS):
        order = rng.permutation(len(pieces))
        words: list[str] = []
        gold: list[int] = []
        for k in order:  # spliced: neighbours are mostly of different languages
            words += pieces[k][0]
            gold += [pieces[k][1]] * len(pieces[k][0])
        for at in range(0, len(words), BATCH * LENGTH):
            part, target = words[at : at + BATCH * LENGTH], np.array(gold[at : at + BATCH * LENGTH])
            width = -(-len(part) // LENGTH)
            field = Field(labels, weights, move, lexicon)
            mask = (np.arange(width * LENGTH) < len(part)).reshape(width, LENGTH).T
            emit = np.zeros((width * LENGTH, size))
            emit[: len(part)] = field.emissions(part)
            marginal, pairs = forward_backward(emit.reshape(width, LENGTH, size).transpose(1, 0, 2), move, mask)
            error = marginal.transpose(1, 0, 2).reshape(-1, size)[: len(part)]
            error[np.arange(len(part)), target] -= 1
            ids, starts = features(part, buckets)
            owner = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(ids))))
            touched, which = np.unique(ids, return_inverse=True)
            g = np.zeros((len(touched), size))
            np.add.at(g, which, error[owner])
            g = g / len(part) + DECAY * weights[touched]
            seen[touched] += (g * g).mean(1, keepdims=True) * len(part)
            weights[touched] -= RATE * np.sqrt(len(part)) * g / np.sqrt(seen[touched])
            grid = np.full(width * LENGTH, -1)
            grid[: len(part)] = target
            grid = grid.reshape(width, LENGTH)
            pair = (grid[:, :-1] >= 0) & (grid[:, 1:] >= 0)
            np.subtract.at(pairs, (grid[:, :-1][pair], grid[:, 1:][pair]), 1)
            g = pairs / len(part)
            moved += g * g * len(part)
            move -= RATE * np.sqrt(len(part)) * g / np.sqrt(moved)
    return Field(labels, weights.astype(np.float32), move, lexicon)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def threshold(n: int, size: int) -> int:
    """The 63-bit hash below which about 3 * size of n documents lie; never 0."""
    return max(1, min(2**63 - 1, int(2**63 * (3 * size / n)))) if n > 3 * size else 2**63 - 1


def sample(docs: DataFrame, size: int = SAMPLE, total: int = TOTAL) -> list[tuple[list[list[str]], str]]:
    """(pieces, lang) of at most `size` documents of each language, fewer where languages are over total / size, that are not held out.

    Of rows that share a doc_id one is taken. What reaches the driver is bounded: `size` documents of each
    language, PIECES * PIECE words of each, LONGEST characters of a word.
    """
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    size = max(1, min(size, total // len(counts)))
    # The share of a language that is looked at follows from its count, so that few rows are ranked.
    cut = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, threshold(n, size))])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.string()))
        yield pa.record_batch([*batch.columns[:3], pa.array([pieces_of(t) for t in batch.column(3).to_pylist()], kind)], ["lang", "h", "doc_id", "pieces"])

    near = rows.where(F.col("h") <= F.try_element_at(cut, F.col("lang"))).select("lang", "h", "doc_id", "text")
    near = map_batches(near, work, "lang string, h long, doc_id long, pieces array<array<string>>")
    near = near.groupBy("lang", "h", "doc_id").agg(F.min("pieces").alias("pieces"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("rank") <= size)
    return sorted((r.pieces, r.lang) for r in ranked.select("pieces", "lang").collect())


def identified(docs: DataFrame) -> DataFrame:
    """One row per row of documents (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Null text, or text without a letter: und with score 0; so is all if nothing can be learned from. Null
    doc_id: not held out and not learned from. The score is the mean marginal of the chosen label. Extra
    columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    field = fit(sample(docs))
    packed = spark.sparkContext.broadcast(field)  # its size is bounded by WEIGHTS and the words of the sample

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        field = packed.value
        texts = [words_of(t) for t in batch.column(2).to_pylist()]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [k for k, t in enumerate(texts) if t]
        if field is not None and some:
            for k, mean in zip(some, field.marginals([texts[k] for k in some]), strict=True):
                best = int(mean.argmax())
                names[k], scores[k] = field.labels[best], float(min(1.0, mean[best]))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), work, "doc_id long, held_out boolean, lang_pred string, score double", 4000, 24)  # many texts at once share words and steps


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))


QUERIES = {"op2_langid": op2_langid}
ORACLES: dict[str, str] = {}
