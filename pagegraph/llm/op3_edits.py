"""Edit-aware token counts: a segment tree over the pre-tokens of a document.

The leaves are blocks of pre-tokens with their numbers of characters and tokens; inner nodes hold
sums. An edit finds its place by descending on characters, splits and encodes anew only the region it
touches with boundary context, until a boundary of the old text fits again, and updates the sums
on the way up. Strings of special tokens count as ordinary text.

Trees are kept as a table: a text with the numbers of characters and tokens of its blocks. A tree that is read back
splits only the blocks that an edit reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.llm import bpe
from pagegraph.llm.common import map_batches, table, written

BLOCK = 64


class CountTree:
    """The token count of a text that is edited; built from a text, or from a text and the sums of its blocks."""

    def __init__(self, text: str, vocabulary: bpe.Bpe, chars: list[int] | None = None, counts: list[int] | None = None) -> None:
        self.vocabulary = vocabulary
        #: Pre-tokens that edits have encoded anew: new ones, and those beside them in their blocks.
        self.encoded = 0
        #: What the blocks were split from: block k stands in it at whence[k] as long as blocks[k] is None.
        self.source = text
        if chars is None or counts is None:
            pieces = vocabulary.pieces(text)
            blocks = [pieces[k : k + BLOCK] for k in range(0, len(pieces), BLOCK)] or [[]]
            chars, counts = [sum(map(len, b)) for b in blocks], [self._tokens(b) for b in blocks]
        self.blocks: list[list[str] | None] = [None] * len(chars)
        self.whence = list(accumulate(chars[:-1], initial=0))
        self._sums(chars, counts)

    def _tokens(self, pieces: list[str]) -> int:
        known, get = self.vocabulary.known, self.vocabulary.of_piece
        return sum(len(known.get(p) or get(p)) for p in pieces)

    def _sums(self, chars: list[int], counts: list[int]) -> None:
        self.width = 1 << (len(chars) - 1).bit_length()
        rest = [0] * (self.width - len(chars))
        self.chars, self.counts = [*[0] * self.width, *chars, *rest], [*[0] * self.width, *counts, *rest]
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.counts[node] = self.counts[2 * node] + self.counts[2 * node + 1]

    def block(self, k: int) -> list[str]:
        """The pre-tokens of a block; one that no edit has reached is split now, with what decides its last one behind it."""
        found = self.blocks[k]
        if found is None:
            start, size = self.whence[k], self.chars[self.width + k]
            found, left = [], size
            for piece in self.vocabulary.pieces(self.source[start : start + size + bpe.LOOK]):
                if left <= 0:
                    break
                found.append(piece)
                left -= len(piece)
            self.blocks[k] = found
        return found

    @property
    def n_tokens(self) -> int:
        return self.counts[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def state(self) -> tuple[str, list[int], list[int]]:
        """The text, and characters and tokens of its blocks that are not empty."""
        live = [k for k in range(len(self.blocks)) if self.chars[self.width + k]] or [0]
        return self.text(), [self.chars[self.width + k] for k in live], [self.counts[self.width + k] for k in live]

    def text(self) -> str:
        return "".join(self.source[s : s + self.chars[self.width + k]] if b is None else "".join(b) for k, (b, s) in enumerate(zip(self.blocks, self.whence, strict=True)))

    def _find(self, at: int) -> tuple[int, int, int]:
        """(block, index in it, start) of the pre-token that holds the character `at`; past the end: after the last one."""
        if at >= self.chars[1]:
            last = len(self.blocks) - 1
            return last, len(self.block(last)), self.chars[1]
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        block = node - self.width
        for k, piece in enumerate(self.block(block)):
            if at < start + len(piece):
                return block, k, start
            start += len(piece)
        raise AssertionError("sums do not fit")

    def _from(self, block: int, index: int) -> Iterator[tuple[int, int, str]]:
        for b in range(block, len(self.blocks)):
            pieces = self.block(b)
            for k in range(index if b == block else 0, len(pieces)):
                yield b, k, pieces[k]

    def edit(self, at: int, deleted: int, inserted: str) -> None:
        """Replaces `deleted` characters from `at` on by `inserted`; both are cut to the text."""
        at = max(0, min(at, self.n_chars))
        end = min(self.n_chars, at + max(0, deleted))
        # Pre-tokens that end LOOK characters before the edit cannot change.
        first, index, start = self._find(max(0, at - bpe.LOOK))
        left, where = [], start
        for _, _, piece in self._from(first, index):
            if where >= at:
                break
            left.append(piece)
            where += len(piece)
        head = "".join(left)[: at - start] + inserted
        block, k, where = self._find(end)
        rest = self._from(block, k)
        tail, bounds, goes_on = "", {}, True  # bounds: place in the new text -> place of the old pre-token
        take = 4
        base = where - end  # at most 0: the part of the first pre-token that is deleted
        while True:
            for _ in range(take):
                found = next(rest, None)
                if found is None:
                    goes_on = False
                    break
                if base >= 0:
                    bounds[len(head) + base] = found[:2]
                tail += found[2][-base:] if base < 0 else found[2]
                base += len(found[2])
            new = self.vocabulary.pieces(head + tail)
            meet, here = None, 0
            for n, piece in enumerate(new):
                if here in bounds and (not goes_on or here + bpe.LOOK <= len(head) + len(tail)):
                    meet = (n, bounds[here])
                    break
                here += len(piece)
            if meet is None and not goes_on:
                meet = (len(new), (len(self.blocks) - 1, len(self.block(len(self.blocks) - 1))))
            if meet is not None:
                break
            take *= 2
        self._replace(first, index, meet[1], new[: meet[0]])

    def _replace(self, first: int, index: int, to: tuple[int, int], pieces: list[str]) -> None:
        last, until = to
        kept = self.block(last)[until:]
        joined = self.block(first)[:index] + pieces + (kept if first == last else [])
        for b in range(first + 1, last):
            self.blocks[b] = []
        if first != last:
            self.blocks[last] = kept
        if len(joined) > 2 * BLOCK:  # it is split into blocks of its own; the others keep their sums
            parts = [joined[k : k + BLOCK] for k in range(0, len(joined), BLOCK)]
            leaves = slice(self.width, self.width + len(self.blocks))
            chars, counts = self.chars[leaves], self.counts[leaves]
            self.blocks[first : first + 1] = parts
            self.whence[first : first + 1] = [0] * len(parts)
            chars[first : first + 1] = counts[first : first + 1] = [0] * len(parts)
            self._sums(chars, counts)
            changed = range(first, last + len(parts))
        else:
            self.blocks[first] = joined
            changed = range(first, last + 1)
        nodes = set()
        for b in changed:
            self.chars[self.width + b], self.counts[self.width + b] = sum(map(len, self.blocks[b])), self._tokens(self.blocks[b])
            self.encoded += len(self.blocks[b])
            nodes.add((self.width + b) // 2)
        while nodes:
            for node in nodes:
                if node:
                    self._sum(node)
            nodes = {node // 2 for node in nodes if node > 1}


TREE = "doc_id long, text string, chars array<int>, tokens array<int>"


def trees(docs: DataFrame, *carry: str, path: str | None = None) -> DataFrame:
    """The trees of documents (doc_id, text), to be kept: doc_id, text, chars, tokens, and the columns `carry` as they are. Null text: empty."""
    path = path or bpe.default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocabulary, ints = bpe.load(path), pa.list_(pa.int32())
        states = [CountTree(t, vocabulary).state() for t in batch.column(1).to_pylist()]
        sums = [pa.array([s[k] for s in states], ints) for k in (1, 2)]
        yield pa.record_batch([batch.column(0), batch.column(1), *sums, *batch.columns[2:]], ["doc_id", "text", "chars", "tokens", *carry])

    more = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[2:])
    return map_batches(rows, work, f"{TREE}, {more}" if carry else TREE)


def edited(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Trees (doc_id, text, chars, tokens, edits) after their edits, with n_tokens, n_edits, n_tokens_after, n_pieces_encoded."""
    path = path or bpe.default_path()
    names = ["n_tokens", "n_edits", "n_tokens_after", "n_pieces_encoded"]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocabulary, ints = bpe.load(path), pa.list_(pa.int32())
        out: list[list[int]] = [[], [], [], []]
        states = []
        for _, text, chars, tokens, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tree = CountTree(text, vocabulary, chars, tokens)
            out[0].append(tree.n_tokens)
            edits = [e for e in edits or [] if e is not None]
            for e in edits:
                tree.edit(e["at"] or 0, e["deleted"] or 0, e["inserted"] or "")
            out[1].append(len(edits))
            out[2].append(tree.n_tokens)
            out[3].append(tree.encoded)
            states.append(tree.state())
        kept = [pa.array([s[0] for s in states], pa.string()), *[pa.array([s[k] for s in states], ints) for k in (1, 2)]]
        yield pa.record_batch([batch.column(0), *kept, *[pa.array(c, pa.int64()) for c in out]], ["doc_id", "text", "chars", "tokens", *names])

    return map_batches(rows.select("doc_id", "text", "chars", "tokens", "edits"), work, f"{TREE}, {', '.join(f'{n} long' for n in names)}")


def edited_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of documents (doc_id, text, edits): counts before and after its edits.

    edits is array<struct<at:bigint,deleted:bigint,inserted:string>>, applied one after the other to what
    the earlier ones left; places past the end are cut to it. Returns doc_id, n_tokens, n_edits,
    n_tokens_after, n_pieces_encoded. Null text: empty. Null edits: none; nulls in an edit count as 0 or ''.
    Repeated rows, and rows without a doc_id, are each counted. Extra columns are not read.
    """
    edits = F.col("edits").cast("array<struct<at:bigint,deleted:bigint,inserted:string>>").alias("edits")
    kept = written(trees(docs.select("doc_id", "text", edits), "edits", path=path), "op3-trees")
    return edited(kept, path).select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pieces_encoded")


def op3_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of each text: a replacement at a quarter, an insertion in the middle, a deletion at three quarters."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    edit = lambda at, deleted, inserted: F.struct(at.alias("at"), F.lit(deleted).cast("long").alias("deleted"), F.lit(inserted).alias("inserted"))
    edits = F.array(edit(F.floor(n / 4), 9, "an edited word"), edit(F.floor(n / 2), 0, "\n\nA new paragraph, 2024.\n"), edit(F.floor(3 * n / 4), 25, ""))
    return edited_counts(table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits")))


QUERIES = {"op3_edits": op3_edits}
ORACLES: dict[str, str] = {}
