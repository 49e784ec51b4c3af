r"""Ranked lexical search: an inverted index in shards, searched document at a time.

A shard holds the documents of a stretch of a scan, SHARD_BYTES of text, in order of doc_id; its postings are
a row for each term, places of documents as differences and counts, as variable-length bytes. Texts are read
once and never shuffled. A worker keeps one shard's terms. The index is a table in the shared folder: rows
with a term are postings, the row without one has the shard's documents with their lengths.

Statistics are sums over shards. A batch of queries meets each shard's postings of its terms: cursors on a
term's postings lie in a heap by document, and the k best results so far in another, by score, then doc_id.
When a shard's k-th score is reached, terms that cannot lift a document above it together leave the first
heap and are only looked up for documents that others bring; a document is given up as soon as what is left
cannot lift it. This loses none: a later document with the k-th score has the larger doc_id. The shards'
results meet by query, each shard sending k at most.

Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z taken as a-z. A term's weight, by N
documents with a term, df with this one, is floor(1000 ln((2N + 2) / (2df + 1))); its part of a score, tf
times in a document of n terms, is weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + (50 n N) div L, L all
terms.

Defined results: a null text and one without terms are in no result and no count; a null doc_id is larger
than others; rows that share a doc_id are documents of their own, and so are queries that share an item_id;
a query without terms, or with terms that no document holds, has no results; a text that is larger than a
shard is one of its own; empty tables give no rows. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwerk.llm.common import documents, written

#: UTF-8 bytes of text in a shard.
SHARD_BYTES = 16 << 20
K = 50
#: Pairs of query and term that are searched at once; more queries are searched in so many blocks.
BLOCK_TERMS = 200_000
#: Rows of an Arrow batch of postings.
ROWS = 50_000

INDEX = "shard long, term string, df long, tokens long, postings binary"
INDEX_TYPES = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("tokens", pa.int64()), ("postings", pa.binary())])
FOUND = "query long, doc_id long, score long"
FOUND_TYPES = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

#: What stands for a byte: letters, digits and bytes beyond ASCII for themselves, A-Z for a-z, others end a term.
BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 0 and more as bytes, seven bits each, the last below 128; and where each ends."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        sizes += values >> np.uint64(bits) > 0
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at, left = ends - sizes, np.arange(len(values))
    k = 0
    while len(left):
        more = sizes[left] > k + 1
        out[at[left] + k] = (values[left] >> np.uint64(7 * k)).astype(np.uint8) & 127 | more.astype(np.uint8) << 7
        left, k = left[more], k + 1
    return out, ends


def numbers(data: bytes) -> np.ndarray:
    """What varints made."""
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(raw) else np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts) if len(raw) else np.zeros(0, np.int64)


#: In the stored list of ids, what stands for none.
NO_ID = np.iinfo(np.int64).min


class Shard:
    """Documents that come, until they are a shard."""

    def __init__(self) -> None:
        self.names: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.tokens: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = terms(text)
        self.bytes += len(text)
        if words:
            self.ids.append(doc_id)
            self.tokens.append(np.fromiter(map(self.names.__getitem__, words), np.int32, len(words)))

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """INDEX of this shard."""
        if not self.ids:
            return
        given = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((given, [i is None for i in self.ids]))
        lengths = np.array([len(self.tokens[i]) for i in order], np.int64)
        # Each pair of term and document once, with its count.
        keys = np.concatenate([self.tokens[i].astype(np.int64) * len(order) + k for k, i in enumerate(order)])
        self.tokens = []
        keys, counts = np.unique(keys, return_counts=True)
        term, doc = np.divmod(keys, len(order))
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        step = np.diff(doc, prepend=0)
        step[first] = doc[first]
        data, ends = varints(np.stack([step, counts], 1).ravel())
        cuts = np.concatenate([[0], ends[1::2][np.append(first[1:], len(doc)) - 1]])
        names = [t.decode() for t in self.names]
        df = np.diff(np.append(first, len(doc)))
        of = term[first]
        own = given[order].tobytes() + lengths.tobytes()
        yield pa.RecordBatch.from_pydict({"shard": [number], "term": [None], "df": [len(order)], "tokens": [int(lengths.sum())], "postings": [own]}, INDEX_TYPES)
        for at in range(0, len(first), ROWS):
            end = min(at + ROWS, len(first))
            part = pa.BinaryArray.from_buffers(pa.binary(), end - at, [None, pa.py_buffer((cuts[at : end + 1] - cuts[at]).astype(np.int32).tobytes()), pa.py_buffer(data[cuts[at] : cuts[end]].tobytes())])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(end - at, number)), pa.array([names[k] for k in of[at:end].tolist()], pa.string()), pa.array(df[at:end]), pa.nulls(end - at, pa.int64()), part,
            ], schema=INDEX_TYPES)


@dataclass
class Index:
    """postings: INDEX. documents and tokens: N and L."""

    postings: DataFrame
    documents: int
    tokens: int


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    """An index over all terms of all documents (doc_id, text), in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, numbers_ = Shard(), count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = (text.as_py() or "").encode()
                if shard.bytes and shard.bytes + len(text) > shard_bytes:
                    yield from shard.rows(next(numbers_))
                    shard = Shard()
                shard.add(doc_id, text)
        yield from shard.rows(next(numbers_))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = written(rows.mapInArrow(run, INDEX), "postings")
    n, tokens = table.filter("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    return Index(table, n, tokens)


class Postings:
    """A term's documents in a shard, in order, with their parts of the score."""

    __slots__ = ("docs", "most", "parts")

    def __init__(self, docs: np.ndarray, parts: np.ndarray):
        self.docs, self.parts, self.most = docs.tolist(), parts.tolist(), int(parts.max())


def best(lists: list[Postings], k: int) -> list[tuple[int, int]]:
    """(score, place) of the k best documents with a score above 0; of equal ones those with smaller places."""
    lists = sorted((p for p in lists if p.most > 0), key=lambda p: p.most)
    reach = list(accumulate(p.most for p in lists))
    #: Lists before this one cannot together lift a document into the results.
    needed = 0
    results: list[tuple[int, int]] = []
    floor = 0
    cursors = [(p.docs[0], i, 0) for i, p in enumerate(lists)]
    heapq.heapify(cursors)
    while cursors:
        doc, score = cursors[0][0], 0
        while cursors and cursors[0][0] == doc:
            _, i, at = cursors[0]
            p = lists[i]
            score += p.parts[at]
            if at + 1 < len(p.docs):
                heapq.heapreplace(cursors, (p.docs[at + 1], i, at + 1))
            else:
                heapq.heappop(cursors)
        for i in range(needed - 1, -1, -1):
            if score + reach[i] <= floor:
                break
            p = lists[i]
            at = bisect_left(p.docs, doc)
            if at < len(p.docs) and p.docs[at] == doc:
                score += p.parts[at]
        if score <= floor:
            continue
        if len(results) < k:
            heapq.heappush(results, (score, -doc))
        else:
            heapq.heapreplace(results, (score, -doc))
        if len(results) == k:
            floor = results[0][0]
            if needed < len(lists) and reach[needed] <= floor:
                while needed < len(lists) and reach[needed] <= floor:
                    needed += 1
                cursors = [c for c in cursors if c[1] >= needed]
                heapq.heapify(cursors)
    return [(score, -place) for score, place in results]


def searcher(queries: list[tuple[int, list[str]]], weights: dict[str, int], n: int, tokens: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of INDEX, by shard, its documents first -> FOUND: each shard's k best for each query."""

    def shard(ids: np.ndarray, lengths: np.ndarray, lists: dict[str, bytes]) -> pa.RecordBatch:
        m = 20 * (50 + 50 * lengths * n // tokens)
        held: dict[str, Postings] = {}
        for term, data in lists.items():
            step, tf = numbers(data).reshape(-1, 2).T
            docs = np.cumsum(step)
            held[term] = Postings(docs, weights[term] * (1_000_000_000 * tf // (1000 * tf + m[docs])))
        out = [(query, ids[place], score) for query, words in queries for score, place in best([held[t] for t in words if t in held], k)]
        return pa.RecordBatch.from_pylist([{"query": q, "doc_id": None if d == NO_ID else int(d), "score": s} for q, d, s in out], FOUND_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, lengths, lists = None, None, None, {}
        for batch in batches:
            for number, term, data in zip(batch["shard"].to_pylist(), batch["term"].to_pylist(), batch["postings"], strict=True):
                if number != now:
                    if lists:
                        yield shard(ids, lengths, lists)
                    now, lists = number, {}
                data = data.as_py()
                if term is None:
                    ids, lengths = np.frombuffer(data, np.int64).reshape(2, -1)
                else:
                    lists[term] = data
        if lists:
            yield shard(ids, lengths, lists)

    return run


def query_terms(items: DataFrame) -> DataFrame:
    """query (a number), item_id and words, the terms of each item once; written, as numbers must stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted({t.decode() for t in terms((x or "").encode())}) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(words, pa.list_(pa.string()))], ["item_id", "words"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, words array<string>")
    return written(rows.filter(F.size("words") > 0).select(F.monotonically_increasing_id().alias("query"), "item_id", "words"), "queries")


def search(index_: Index, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the k best documents of each item (item_id, text)."""
    spark, postings = items.sparkSession, index_.postings
    queries = query_terms(items)
    total = queries.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = -(-total // block_terms)
    found = spark.createDataFrame([], FOUND)
    for block in range(blocks if index_.tokens else 0):
        # A block's terms, about block_terms of them, are what the driver and the tasks hold.
        own = [(r["query"], r["words"]) for r in queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "words").collect()]
        words = spark.createDataFrame([(t,) for t in sorted({t for _, ws in own for t in ws})], "term string")
        some = postings.join(F.broadcast(words), "term", "left_semi")
        weight = F.floor(1000 * F.log((2.0 * index_.documents + 2) / (2.0 * F.sum("df") + 1))).alias("weight")
        weights = {r["term"]: r["weight"] for r in some.groupBy("term").agg(weight).collect()}
        known = [(q, [t for t in ws if t in weights]) for q, ws in own]
        rows = some.unionByName(postings.filter("term is null")).select("shard", "term", "postings").repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        results = rows.mapInArrow(searcher(known, weights, index_.documents, index_.tokens, k), FOUND)
        found = results if blocks == 1 else found.unionByName(written(results, f"found-{block}"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    top = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return top.join(queries.select(F.col("query").alias("q_"), "item_id"), F.col("query") == F.col("q_")).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = """with words as (select doc_id, row_number() over () as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
sizes as (select r, doc_id, len(w)::bigint as n from words where len(w) > 0),
total as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from sizes),
query as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t from benchmark),
counts as (select r, t, count(*)::bigint as tf from (select r, unnest(w) as t from words) where t in (select t from query) group by r, t),
weights as (select t, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::bigint as w from counts, total group by t, big_n),
scores as (select item_id, sizes.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::bigint as score
 from query join weights using (t) join counts using (t) join sizes using (r), total group by item_id, sizes.r, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scores where score > 0 qualify rank <= 50"""
