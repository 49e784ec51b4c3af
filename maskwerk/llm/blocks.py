"""Blocks of documents that ask buckets of keys, and get answers back by block.

Operators that compare all documents with all need to know which of a document's many keys other documents
have too. Documents are dealt into blocks by a hash of their id; a block sends each bucket one row with
all keys that fall to it; the bucket answers each block with one row of as many small answers, in the
same order. Keys travel as packed arrays, answers as bytes, and no key's holders meet in a list.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASK = "bucket int, block int, keys binary, extra binary, body binary"
ANSWER = "block int, bucket int, answer binary"
ASK_TYPES = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary()), ("body", pa.binary())])
ANSWER_TYPES = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary())])

U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def in_blocks(docs: DataFrame, blocks: int, keep: list[str] | None = None) -> DataFrame:
    """doc_id (long), text, block and the columns named in keep."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    block = F.pmod(F.xxhash64(doc_id, F.octet_length(text)), F.lit(blocks)).cast("int")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), block.alias("block"), *[F.col(c) for c in keep or ()])


class Texts:
    """A block's documents, in a fixed order: UTF-8 bytes in one buffer, and where each begins.

    Rows reach a task in any order, so they are put in order of doc_id, then of text.
    """

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        ids = table["doc_id"].to_numpy(zero_copy_only=False) if not table["doc_id"].null_count else None
        if ids is not None and len(np.unique(ids)) == len(ids):
            table = table.take(pa.array(np.argsort(ids, kind="stable")))
        else:
            table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.table, self.doc_id = table, table["doc_id"]
        texts = table["text"].combine_chunks().cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]]
        self.starts = offsets - offsets[0]
        #: Documents without an id take part in nothing.
        self.known = np.asarray(self.doc_id.is_valid())
        self.ids = self.doc_id.fill_null(0).to_numpy().astype(np.int64)

    def __len__(self) -> int:
        return len(self.ids)


def packed(bucket: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts items by bucket, keeping theirs, and where each bucket begins in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(count + 1))


def asked(block: int, bucket: np.ndarray, count: int, keys: np.ndarray, extra: np.ndarray | None = None) -> pa.Table:
    """Rows of ASK for a block's keys."""
    order, edges = packed(bucket, count)
    keys, extra = keys[order], None if extra is None else extra[order]
    full = [b for b in range(count) if edges[b] < edges[b + 1]]
    return pa.table({
        "bucket": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32()),
        "keys": pa.array([keys[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
        "extra": pa.array([b"" if extra is None else extra[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
        "body": pa.array([b""] * len(full), pa.binary()),
    }, schema=ASK_TYPES)


def joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The arrays packed in the rows of a column, end to end, and where each row's begins."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.cumsum([0, *map(len, parts)])


def answered(table: pa.Table, answers: list[bytes]) -> pa.Table:
    return pa.table({"block": table["block"].combine_chunks(), "bucket": table["bucket"].combine_chunks(), "answer": pa.array(answers, pa.binary())}, schema=ANSWER_TYPES)


def unpacked(table: pa.Table, bucket: np.ndarray, count: int, kind) -> np.ndarray:
    """A block's answers in the order of its keys; 0 where a bucket has not answered."""
    order, edges = packed(bucket, count)
    out = np.zeros(len(bucket), kind)
    for b, raw in zip(table["bucket"].to_pylist(), table["answer"].to_pylist(), strict=True):
        out[order[edges[b] : edges[b + 1]]] = np.frombuffer(raw, kind)
    return out


def ask(blocks: DataFrame, function: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
    """Rows of ASK from function(block, documents)."""
    return blocks.groupBy("block").applyInArrow(lambda key, t: function(key[0].as_py(), t), ASK)


def answer(asks: DataFrame, function: Callable[[pa.Table], list[bytes]], schema: str = ANSWER) -> DataFrame:
    """Rows of ANSWER; function gets a bucket's rows in order of block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending")])
        return answered(table, function(table))

    return asks.groupBy("bucket").applyInArrow(run, schema)


def told(blocks: DataFrame, answers: DataFrame, function: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """function(block, documents, answers) for every block, answers or none."""

    def run(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        return function(key[0].as_py(), docs, replies.sort_by([("bucket", "ascending")]))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
