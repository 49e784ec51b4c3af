"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

Documents link when the Jaccard similarity of their sets of word n-grams reaches a threshold; the join
gives each document its component.

1. Blocks of documents ask which of their n-grams another document has (blocks.py). A document with too
   few of those for the threshold by its size links with nothing and is done.
2. The others are reduced to classes of equal sets. Of each class the rarest n-grams, as many as the
   size-derived bound asks for, are its prefix: linked classes share one. Classes with a common prefix
   n-gram come into one cluster. Postings are summed up within each task before they are shuffled.
3. In a cluster rows of the incidence matrix are multiplied, block by block, with the columns that are
   not in a component yet: overlaps are accumulated, pairs below the bound of their sizes discarded, and
   what links leaves the columns. A group of near copies thus costs about one product with its first
   members, not one with all. A cluster of over SPREAD n-grams is no single task: all its classes, dealt out
   evenly, are held against a few of them (PIVOTS), and the largest component that this makes needs no
   comparison in itself any more. What is left of the cluster is compared with all of it, in blocks that grow
   with it, up to CLUSTER n-grams.
4. Components over the links found are labelled with their smallest doc_id.

Sets are held as 64-bit hashes of n-grams, classes as 64-bit hashes of sets.

Defined results: a null or empty text has an empty set and links with nothing; a row without doc_id may
link others but never names a component unless no other row is in it, which then is null; rows that
share a doc_id are nodes of their own; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from maskwerk.llm import blocks as B
from maskwerk.llm.common import BLOCK_BYTES, checkpointed, documents, text_bytes, written
from maskwerk.operators.graph import components, forest

U64 = np.uint64
#: Bytes that are hashed at once.
CHUNK = 1 << 20
#: N-grams, over all classes, of the largest block of a cluster; a task compares two blocks.
CLUSTER = 2_500_000
#: N-grams from which on a cluster is dealt out, and how many of its classes all are first held against.
SPREAD, PIVOTS = 100_000, 4
#: Postings that a task sums up at once.
POSTINGS = 400_000
#: Rows of a block in the product, and overlaps that it accumulates at once.
ROWS, CELLS = 64, 500_000


class Sets:
    """Sorted sets of n-gram hashes of a block's texts: tokens end to end, and where each begins."""

    def __init__(self, texts: B.Texts, n: int):
        data = texts.bytes
        white = (data == 32) | ((data >= 9) & (data <= 13))
        first = ~white
        if len(data):
            edge = np.zeros(len(data) + 1, bool)
            edge[texts.starts] = True
            first[1:] &= white[:-1] | edge[1:-1]
        starts = np.flatnonzero(first)
        words = self._hashes(data, white, starts)
        per_doc = np.searchsorted(starts, texts.starts)
        sets: list[np.ndarray] = []
        runs = self._windows(words, n)
        for a, b in zip(per_doc[:-1].tolist(), per_doc[1:].tolist(), strict=True):
            if b - a >= n:
                sets.append(np.unique(runs[a : b - n + 1]))
            elif b > a:
                sets.append(self._windows(words[a:b], b - a))
            else:
                sets.append(words[:0])
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.begin = np.append(0, np.cumsum(self.sizes))
        self.tokens = np.concatenate([*sets, words[:0]])

    @staticmethod
    def _hashes(data: np.ndarray, white: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A hash of each word with A-Z lower-cased: products of its letters' and their places' numbers, summed up."""
        letters = np.arange(256, dtype=U64)
        letters[65:91] += U64(32)
        letters = B.mixed(letters + U64(0x1234567))
        longest = int(np.diff(np.append(starts, len(data))).max(initial=1))
        places = B.mixed(np.arange(longest + 1, dtype=U64) + U64(0xABCDEF)) | U64(1)
        out = np.empty(len(starts), U64)
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + CHUNK)))
            lo, hi = int(starts[a]), int(starts[b]) if b < len(starts) else len(data)
            own = starts[a:b] - lo
            place = np.arange(hi - lo) - np.repeat(own, np.diff(np.append(own, hi - lo)))
            part = letters[data[lo:hi]] * places[place]
            part[white[lo:hi]] = 0
            out[a:b] = np.add.reduceat(part, own)
            a = b
        return B.mixed(out)

    @staticmethod
    def _windows(words: np.ndarray, n: int) -> np.ndarray:
        count = max(0, len(words) - n + 1)
        out = np.full(count, n, U64)
        for k in range(n):
            out = B.mixed(out ^ words[k : k + count]) * U64(0x9E3779B97F4A7C15)
        return B.mixed(out)

    def sum_of(self, x: np.ndarray) -> np.ndarray:
        """Sums over each set of a value for each token."""
        total = np.append(np.zeros(1, x.dtype), np.cumsum(x))
        return total[self.begin[1:]] - total[self.begin[:-1]]

    def keys(self) -> np.ndarray:
        """A hash of each set."""
        return B.mixed(self.sum_of(B.mixed(self.tokens ^ U64(0x5851F42D4C957F2D))) ^ self.sizes.astype(U64))


class Join:
    """The steps over blocks and buckets. Linked: den * intersection >= num * union."""

    def __init__(self, n: int, num: int, den: int, buckets: int):
        self.n, self.num, self.den, self.buckets = n, num, den, buckets

    def least(self, sizes: np.ndarray) -> np.ndarray:
        """Common n-grams that a set needs at least with any set it links with."""
        return -(-self.num * sizes // self.den)

    def distinct(self, sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        tokens, which, count = np.unique(sets.tokens, return_inverse=True, return_counts=True)
        return tokens, which, count, ((tokens >> U64(32)) % U64(self.buckets)).astype(np.int32)

    def ask(self, block: int, table: pa.Table) -> pa.Table:
        tokens, _, count, bucket = self.distinct(Sets(B.Texts(table), self.n))
        return B.asked(block, bucket, self.buckets, (tokens.astype(np.uint32) & ~np.uint32(1)) | (count > 1).astype(np.uint32))

    @staticmethod
    def answer(table: pa.Table) -> list[bytes]:
        """For each n-gram, a byte: how many blocks have it (one more if a block has it twice), up to 255."""
        keys, edges = B.joined(table["keys"], np.uint32)
        order = np.argsort(keys, kind="stable")
        bare = keys[order] >> 1
        at = np.flatnonzero(np.append(True, bare[1:] != bare[:-1])[: len(keys)])
        sizes = np.diff(np.append(at, len(keys)))
        count = np.minimum(sizes + np.maximum.reduceat((keys[order] & 1).astype(np.int64), at), 255) if len(keys) else sizes
        out = np.empty(len(keys), np.uint8)
        out[order] = np.repeat(count, sizes)
        return [out[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def survivors(self, block: int, table: pa.Table, replies: pa.Table, keep: list[str]) -> pa.Table:
        """A row for each document; node and tokens (those that others have) only where it may link."""
        texts = B.Texts(table)
        sets = Sets(texts, self.n)
        tokens, which, _, bucket = self.distinct(sets)
        held = B.unpacked(replies, bucket, self.buckets, np.uint8)[which] if len(tokens) else np.zeros(0, np.uint8)
        some = held > 1
        may = (self.den * sets.sum_of(some.astype(np.int64)) >= self.num * sets.sizes) & (sets.sizes > 0)
        keys = sets.keys().view(np.int64)
        kept: list[bytes | None] = []
        for a, b, m in zip(sets.begin[:-1], sets.begin[1:], may, strict=True):
            own, n = sets.tokens[a:b][some[a:b]], held[a:b][some[a:b]]
            # Rare ones first, the same order everywhere: so that prefixes hold what few documents share.
            kept.append(own[np.lexsort((own, n))].tobytes() if m else None)
        out = {"doc_id": texts.doc_id, "n_shingles": pa.array(sets.sizes), "node": pa.array(keys, mask=~may), "tokens": pa.array(kept, pa.binary())}
        return pa.table(out | {c: texts.table[c] for c in keep})

    def prefix(self, sizes: np.ndarray, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Prefix n-grams of classes, and which class each is of.

        Tokens that no other document has come first in the order, so that of the shared ones as many fewer count.
        """
        out = []
        for size, raw in zip(self.least(sizes).tolist(), tokens, strict=True):
            own = np.frombuffer(raw, U64)
            out.append(own[: max(0, len(own) - size + 1)])
        return np.concatenate([*out, np.zeros(0, U64)]), np.repeat(np.arange(len(out)), [len(x) for x in out])

    def postings(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, tokens, nodes, u, v): a posting for each prefix n-gram that a part of the classes has, and edges within the part."""

        def flush(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            tokens, nodes = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(tokens, kind="stable")
            tokens, nodes = tokens[order], nodes[order]
            head = np.append(True, tokens[1:] != tokens[:-1])
            group = np.cumsum(head) - 1
            u, v = forest(nodes, nodes[head][group])
            tokens, nodes = tokens[head], nodes[head]
            bucket = ((tokens >> U64(40)) % U64(self.buckets)).astype(np.int32)
            by, edges = B.packed(bucket, self.buckets)
            full = np.flatnonzero(np.diff(edges))
            rows = {"bucket": pa.array(full, pa.int32()), **{c: pa.array([x[by[edges[b] : edges[b + 1]]].tobytes() for b in full], pa.binary()) for c, x in (("tokens", tokens), ("nodes", nodes))}}
            rows |= {c: pa.array([x.tobytes() if k == 0 else b"" for k in range(len(full))], pa.binary()) for c, x in (("u", u), ("v", v))}
            return pa.RecordBatch.from_pydict(rows)

        parts, held = [], 0
        for batch in batches:
            tokens, which = self.prefix(batch["n_shingles"].to_numpy(), batch["tokens"].to_pylist())
            if len(tokens):
                parts.append((tokens, batch["node"].to_numpy()[which]))
            held += len(tokens)
            if held > POSTINGS:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    @staticmethod
    def edges(table: pa.Table) -> pa.Table:
        """Edges between classes with a common prefix n-gram, a forest for each bucket."""
        tokens, nodes = B.joined(table["tokens"], U64)[0], B.joined(table["nodes"], np.int64)[0]
        order = np.argsort(tokens, kind="stable")
        tokens, nodes = tokens[order], nodes[order]
        head = np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)]
        a = np.concatenate([nodes, B.joined(table["u"], np.int64)[0]])
        b = np.concatenate([nodes[head][np.cumsum(head) - 1], B.joined(table["v"], np.int64)[0]])
        u, v = forest(a, b)
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    def to_pivots(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (cluster, u, v) of classes with their cluster's pivots."""
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            pivots = batch["pivots"].to_pylist()
            for cluster, node, size, raw, some in zip(*(batch[c].to_pylist() for c in ("cluster", "node", "n_shingles", "tokens")), pivots, strict=True):
                own = np.frombuffer(raw, U64)
                for p in some:
                    other = p["p_size"]
                    if p["p_node"] != node and self.den * min(size, other) >= self.num * max(size, other):
                        overlap = len(np.intersect1d(own, np.frombuffer(p["p_tokens"], U64), assume_unique=True))
                        if (self.den + self.num) * overlap >= self.num * (size + other):
                            out.append((cluster, node, p["p_node"]))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in zip(("cluster", "u", "v"), columns, strict=True)})

    def linked(self, nodes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], main: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Links (u, v) that make the components of a cluster's classes; those of main are known to be one already."""
        main = np.zeros(len(nodes), bool) if main is None else main
        order = np.argsort(sizes, kind="stable")
        nodes, sizes, sets, main = nodes[order], sizes[order], [sets[i] for i in order], main[order]
        m = len(nodes)
        tokens, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(m), [len(s) for s in sets])
        common = count[which] > 1  # others cannot add to an overlap
        which, doc = which[common], doc[common]
        rows = np.searchsorted(doc, np.arange(m + 1))
        free = np.ones(m, bool)
        out: list[tuple[int, int]] = []
        live, built = None, 0
        left = m
        for seeds in (np.flatnonzero(main).tolist(), *([i] for i in range(m))):
            front = [i for i in seeds if free[i]]
            free[front] = False
            left -= len(front)
            while front and left:
                if live is None or left * 2 < built:
                    # Columns: classes in no component yet, by token.
                    live = np.flatnonzero(free)
                    at = np.flatnonzero(free[doc])
                    by = at[np.argsort(which[at], kind="stable")]
                    column = np.searchsorted(live, doc[by])
                    starts = np.searchsorted(which[by], np.arange(len(tokens) + 1))
                    built = left
                block, front = front[:ROWS], front[ROWS:]
                width = max(1, min(len(block), CELLS // max(1, len(live))))
                for k in range(0, len(block), width):
                    part = block[k : k + width]
                    own = np.concatenate([which[rows[i] : rows[i + 1]] for i in part])
                    row = np.repeat(np.arange(len(part)), [rows[i + 1] - rows[i] for i in part])
                    lengths = starts[own + 1] - starts[own]
                    overlap = np.zeros(len(part) * len(live), np.int64)
                    ends, done = np.cumsum(lengths), 0
                    while done < len(own):  # so many n-grams at once that their postings fit
                        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + CELLS, "right")))
                        some = slice(done, upto)
                        last = np.cumsum(lengths[some])
                        place = np.arange(last[-1]) - np.repeat(last - lengths[some] - starts[own[some]], lengths[some])
                        overlap += np.bincount(np.repeat(row[some], lengths[some]) * len(live) + column[place], minlength=len(overlap))
                        done = upto
                    overlap = overlap.reshape(len(part), len(live))
                    enough = (self.den + self.num) * overlap >= self.num * (sizes[part][:, None] + sizes[live][None, :])
                    enough &= free[live][None, :]
                    for r, c in zip(*np.nonzero(enough), strict=True):
                        j = int(live[c])
                        if free[j]:
                            free[j] = False
                            left -= 1
                            front.append(j)
                            out.append((nodes[part[r]], nodes[j]))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def links(self, table: pa.Table) -> pa.Table:
        """Links within each cluster of a task; a task holds whole clusters, or two blocks of one, which may share classes."""
        table = table.sort_by([("cluster", "ascending"), ("node", "ascending")])
        cluster, nodes = (table[c].to_numpy() for c in ("cluster", "node"))
        once = np.append(True, (cluster[1:] != cluster[:-1]) | (nodes[1:] != nodes[:-1]))
        table, cluster, nodes = table.filter(pa.array(once)), cluster[once], nodes[once]
        sizes, main = (table[c].to_numpy() for c in ("n_shingles", "main"))
        sets = [np.frombuffer(x, U64) for x in table["tokens"].to_pylist()]
        edges = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1]))
        found = [self.linked(nodes[a:b], sizes[a:b], sets[a:b], main[a:b]) for a, b in zip(edges, [*edges[1:], len(cluster)], strict=True) if b > a + 1]
        u, v = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (zip(*found, strict=True) if found else ((), ())))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _spread(steps: Join, big: DataFrame, spread: int, cluster: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Links found through pivots, and the tasks (node, n_shingles, tokens, cluster, main, task) for what is left, of large clusters.

    big: node, n_shingles, tokens, cluster, size (n-grams of the cluster).
    """
    big = big.withColumn("parts", F.ceil(F.col("size") / spread).cast("int"))
    first = Window.partitionBy("cluster").orderBy(F.xxhash64("node"))
    chosen = big.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= pivots)
    # A few rows of each large cluster, once for each of its parts.
    table = chosen.groupBy("cluster", "parts").agg(F.collect_list(F.struct(F.col("node").alias("p_node"), F.col("n_shingles").alias("p_size"), F.col("tokens").alias("p_tokens"))).alias("pivots"))
    table = table.select(F.col("cluster").alias("c_"), "pivots", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s_"))
    salted = big.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = salted.join(table, (F.col("cluster") == F.col("c_")) & (F.col("salt") == F.col("s_"))).select("cluster", "node", "n_shingles", "tokens", "pivots")
    found = written(met.mapInArrow(steps.to_pivots, "cluster long, u long, v long"), "pivots")
    roots = components(found.select("u", "v")).select(F.col("node").alias("n_"), F.col("root").alias("r_"))
    sized = big.select("node", "cluster").join(roots, F.col("node") == F.col("n_")).groupBy("cluster", "r_").agg(F.count("*").alias("n"))
    largest = sized.groupBy("cluster").agg(F.max_by("r_", F.struct("n", "r_")).alias("m_")).select(F.col("cluster").alias("c_"), "m_")
    rows = big.join(roots, F.col("node") == F.col("n_"), "left").join(largest, F.col("cluster") == F.col("c_"), "left")
    rows = written(rows.withColumn("main", F.coalesce(F.col("r_") == F.col("m_"), F.lit(False))).select("node", "n_shingles", "tokens", "cluster", "size", "main"), "spread")
    # What is left, in n-grams, by cluster; blocks of rows are as large as that, within bounds, so that neither side is sent often.
    rest = rows.filter("not main").groupBy(F.col("cluster").alias("c_")).agg(F.sum(F.octet_length("tokens") / 8).alias("rest"))
    rows = rows.join(rest, F.col("cluster") == F.col("c_"))
    rows = rows.withColumns({"m": F.ceil(F.col("size") / F.greatest(F.lit(spread), F.least("rest", F.lit(cluster)))).cast("int"), "r": F.greatest(F.ceil(F.col("rest") / cluster), F.lit(1)).cast("int")})
    as_row = rows.withColumn("i", F.pmod(F.xxhash64("node"), F.col("m")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("r") - 1)))
    as_rest = rows.filter("not main").withColumn("j", F.pmod(F.xxhash64("node"), F.col("r")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    names = ["node", "n_shingles", "tokens", "cluster", "main", "i", "j"]
    tasks = as_row.select(*names).unionByName(as_rest.select(*names))
    return found.select("u", "v"), tasks.select("node", "n_shingles", "tokens", "cluster", "main", F.xxhash64("cluster", "i", "j").alias("task"))


def _joined(docs: DataFrame, n: int, num: int, den: int, block_bytes: int, cluster: int, keep: list[str], spread: int = SPREAD) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, node, the columns of keep) and, by node, labels (root, component)."""
    total = int(docs.agg(F.sum(text_bytes())).first()[0] or 0)
    blocks = max(16, -(-total // block_bytes))
    steps = Join(n, num, den, blocks)
    dealt = B.in_blocks(docs, blocks, [c for c in keep if c != "text"])
    replies = B.answer(B.ask(dealt, steps.ask), steps.answer)
    fields = T._parse_datatype_string("doc_id long, n_shingles long, node long, tokens binary").fields + [dealt.schema[c] for c in keep]
    rows = written(B.told(dealt, replies, lambda b, t, r: steps.survivors(b, t, r, keep), T.StructType(fields)), "sets")
    some = rows.filter("node is not null")
    classes = some.groupBy("node").agg(F.min("doc_id").alias("lowest"), F.min("n_shingles").alias("n_shingles"), F.max("tokens").alias("tokens"))
    classes = written(classes, "classes")
    posted = classes.select("node", "n_shingles", "tokens").mapInArrow(steps.postings, "bucket int, tokens binary, nodes binary, u binary, v binary")
    clusters = components(posted.groupBy("bucket").applyInArrow(steps.edges, "u long, v long"))
    weights = classes.select(F.col("node").alias("w_"), (F.octet_length("tokens") / 8).alias("weight"))
    sizes = clusters.join(weights, F.col("node") == F.col("w_")).groupBy("root").agg(F.sum("weight").alias("size"))
    # Rows of a few numbers, once for both kinds of clusters.
    placed = checkpointed(clusters.join(sizes, "root").select("node", F.col("root").alias("cluster"), "size"))
    spread = min(spread, cluster)
    wide = classes.join(placed, "node").select("node", "n_shingles", "tokens", "cluster", "size")
    small = wide.filter(F.col("size") <= spread).withColumn("main", F.lit(False)).select("node", "n_shingles", "tokens", "cluster", "main", F.pmod(F.xxhash64("cluster"), F.lit(8 * blocks)).alias("task"))
    compared = lambda tasks: tasks.groupBy("task").applyInArrow(lambda t: steps.links(t), "u long, v long")
    links = compared(small)
    if not placed.filter(F.col("size") > spread).isEmpty():
        found, tasks = _spread(steps, wide.filter(F.col("size") > spread), spread, cluster)
        links = links.union(found).union(compared(tasks))
    parts = components(links)
    named = parts.join(classes.select("node", "lowest"), "node").groupBy("root").agg(F.min("lowest").alias("component"))
    alone = classes.select("node", "lowest").join(parts, "node", "left").join(named, "root", "left")
    return rows.drop("tokens"), alone.select(F.col("node").alias("_node"), F.coalesce("root", "node").alias("root"), F.coalesce("component", "lowest").alias("component"))


def join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, block_bytes: int = BLOCK_BYTES, cluster: int = CLUSTER) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    rows, labels = _joined(docs, n, num, den, block_bytes, cluster, [])
    linked = rows.filter("node is not null").join(labels, F.col("node") == F.col("_node"))
    alone = rows.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).union(alone)


def representatives(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block_bytes: int = BLOCK_BYTES, cluster: int = CLUSTER) -> DataFrame:
    """docs without all but one row of each component: one with the smallest doc_id. doc_id must be a long."""
    names = docs.columns
    rows, labels = _joined(docs, n, num, den, block_bytes, cluster, [c for c in names if c != "doc_id"])
    linked = rows.filter("node is not null").join(labels, F.col("node") == F.col("_node"))
    # Rows that share the smallest doc_id of a component are few; one stays.
    first = Window.partitionBy("root").orderBy("text", *[c for c in names if c not in ("doc_id", "text")])
    best = linked.filter(F.col("doc_id").eqNullSafe(F.col("component"))).withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
    return rows.filter("node is null").select(*names).union(best.select(*names))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))
