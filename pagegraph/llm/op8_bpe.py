"""BPE encoding and decoding by tree concatenation.

A long text is cut into halves down to leaves of LEAF characters; the parts are encoded apart, and
around each join a window is encoded anew that grows until both sides agree exactly. The same holds
for the bytes of one very long pre-token. Nothing is capped: every text is encoded whole.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.llm import bpe
from pagegraph.llm.common import map_batches, table

LEAF = 8192


def packed(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def encoder(path: str | None, leaf: int = LEAF) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    path = path or bpe.default_path()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.load(path)
        ids = [vocabulary.encode(t or "", leaf) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return work


def encoded(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids of each row of documents (doc_id, text); a null text is empty."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), encoder(path, leaf), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of (doc_id, ids)."""
    path = path or bpe.default_path()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.load(path)
        yield pa.record_batch([batch.column(0), pa.array([vocabulary.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_batches(rows.select("doc_id", "ids"), work, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """One row per row of documents: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null or empty text: no tokens, the digests of nothing. Repeated rows, and rows without a doc_id,
    are each encoded. Extra columns are not read.
    """
    path = path or bpe.default_path()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.load(path)
        counts, first, second = [], [], []
        for text in batch.column(1).to_pylist():
            ids = vocabulary.encode(text or "", leaf)
            counts.append(len(ids))
            first.append(hashlib.sha256(packed(ids)).hexdigest())
            second.append(hashlib.sha256(vocabulary.decode(ids).encode()).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict[str, str] = {}
