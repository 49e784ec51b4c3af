"""Suffix-array dedup: removal of byte strings that an earlier document holds too.

A byte goes if a `length`-byte string over it also starts in a document with a smaller doc_id.

A suffix array over every byte would move ten times the input. So suffixes enter it in runs: every window
of `length` bytes has an anchor, the 16-byte token in it whose hash is lowest, and neighbouring windows
with the same anchor form a run. Equal windows have equal anchors, so that

1. blocks ask which anchors occur in two documents at all, and drop the other runs (blocks.py);
2. the text of the rest is range-partitioned by the leading token of the suffix at the anchor, at
   splitters from a sample of the documents; each block sends a run's text once, for its smallest doc_id;
3. a bucket sorts its suffixes by multikey quicksort, eight bytes a key, and compares neighbours over
   `length` bytes: each window learns whether a smaller document has it;
4. blocks put the answers together.

Splitters compare whole leading tokens, so that equal windows never fall on two sides of a boundary. An
anchor with very many different surroundings is not held by one bucket: its windows are sent singly and
partitioned by their own leading bytes. All steps are linear in the text, but for the sorts.

Defined results: a null text is empty; rows without doc_id are returned unchanged and remove nothing;
rows that share a doc_id do not remove from each other; an empty table gives no rows. Kept bytes need not
be whole characters. Columns beside doc_id and text are ignored unless named in `keep`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwerk.llm import blocks as B
from maskwerk.llm.common import BLOCK_BYTES, documents, text_bytes

LENGTH = 50
TOKEN = 16
#: Window starts that are hashed at once.
CHUNK = 1 << 20
#: Surroundings of one anchor that a bucket holds; beyond, windows are sent singly.
HOT = 50_000
#: Bytes of text in the sample for the splitters; of its anchors one in ANCHORS reaches the driver, about 60,000.
SAMPLE_BYTES, ANCHORS = 64 << 20, 64
U64 = np.uint64


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as big-endian numbers; data is padded."""
    rolling = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), shape=(len(data) - 8,), strides=(1,))
    return rolling[at].byteswap()


class Runs:
    """Runs of windows with the same anchor in a block's texts."""

    def __init__(self, texts: B.Texts, length: int):
        self.length = length
        self.data = np.concatenate([texts.bytes, np.zeros(length + 64, np.uint8)])
        total, width = len(texts.bytes), length - TOKEN + 1
        ends, begins = texts.starts[1:], texts.starts[:-1]
        #: Windows that would leave their document, or whose document has no id.
        bad_from = np.where(texts.known, np.maximum(begins, ends - (length - 1)), begins)
        found: list[tuple[np.ndarray, ...]] = []
        for c0 in range(0, total, CHUNK):
            c1 = min(total, c0 + CHUNK)
            n = c1 - c0
            grams = self._grams(c0, n + width - 1)
            ranked = (grams & ~U64((1 << 24) - 1)) | np.arange(len(grams), dtype=U64)
            size = 1
            while size * 2 <= width:
                ranked = np.minimum(ranked[:-size], ranked[size:])
                size *= 2
            if size < width:
                ranked = np.minimum(ranked[: -(width - size)], ranked[width - size :])
            anchor = (ranked & U64((1 << 24) - 1)).astype(np.int64)
            edge = np.zeros(n + 1, np.int32)
            first, last = np.searchsorted(ends, c0, "right"), np.searchsorted(begins, c1, "left")
            np.add.at(edge, np.clip(bad_from[first:last] - c0, 0, n), 1)
            np.add.at(edge, np.clip(ends[first:last] - c0, 0, n), -1)
            good = np.cumsum(edge[:-1]) == 0
            change = np.ones(n, bool)
            change[1:] = (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1])
            starts = np.flatnonzero(change)
            counts = np.diff(np.append(starts, n))
            valid = good[starts]
            starts, counts = starts[valid], counts[valid]
            found.append((starts + c0, counts, anchor[starts] - starts, grams[anchor[starts]]))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))
        self.start, self.count, self.offset, self.gram = (np.concatenate(x) for x in zip(*(found or [empty]), strict=True))
        self.doc = np.searchsorted(ends, self.start, "right")
        self.id = texts.ids[self.doc]

    def _grams(self, c0: int, n: int) -> np.ndarray:
        part = self.data[c0 : c0 + n + TOKEN]
        part = part if len(part) == n + TOKEN else np.concatenate([part, np.zeros(n + TOKEN - len(part), np.uint8)])
        low = np.lib.stride_tricks.as_strided(part[:8].view("<u8"), shape=(n,), strides=(1,))
        high = np.lib.stride_tricks.as_strided(part[8:16].view("<u8"), shape=(n,), strides=(1,))
        return B.mixed(B.mixed(low * U64(0x9E3779B97F4A7C15)) ^ high)

    def content(self) -> np.ndarray:
        """A hash of each run's text; its first and last window cover it."""
        out = B.mixed(self.count.astype(U64))
        for end in (self.start, self.start + self.count - 1):
            for at in (*range(0, self.length - 8, 8), self.length - 8):
                out = B.mixed(out ^ _words(self.data, end + at)) * U64(0x9E3779B97F4A7C15)
        return out

    def take(self, at: np.ndarray) -> Runs:
        out = object.__new__(Runs)
        out.length, out.data = self.length, self.data
        for name in ("start", "count", "offset", "gram", "doc", "id"):
            setattr(out, name, getattr(self, name)[at])
        return out

    def single(self) -> Runs:
        """Each window as a run of its own, with itself as its token."""
        at = np.repeat(np.arange(len(self.start)), self.count)
        out = self.take(at)
        out.start = out.start + _within(self.count)
        out.count, out.offset = np.ones_like(out.start), np.zeros_like(out.start)
        return out

    def tokens(self) -> np.ndarray:
        """The leading token of the suffix at each anchor."""
        return np.ascontiguousarray(self.data[(self.start + self.offset)[:, None] + np.arange(TOKEN)]).view(f"S{TOKEN}").ravel()


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def multikey(n: int, depth: int, word: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort, eight bytes a key: the order of n suffixes, and where neighbours differ.

    Key r is sorted only among suffixes whose keys before it are equal to a neighbour's.
    """
    keys = word(0, np.arange(n))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.ones(n, bool)
    head[1:] = keys[1:] != keys[:-1]
    for r in range(1, depth):
        edges = np.flatnonzero(head)
        sizes = np.diff(np.append(edges, n))
        open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(open_):
            break
        group = np.repeat(np.arange(len(edges)), sizes)[open_]
        part = order[open_]
        keys = word(r, part)
        by = np.lexsort((keys, group))
        order[open_], keys = part[by], keys[by]
        head[open_] = np.append(True, (keys[1:] != keys[:-1]) | (group[1:] != group[:-1]))
    return order, head


def _lowest(order: np.ndarray, head: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item the number of its class, and for each class its lowest id."""
    label = np.empty(len(order), np.int64)
    label[order] = np.cumsum(head) - 1
    return label, np.minimum.reduceat(ids[order], np.flatnonzero(head)) if len(order) else np.zeros(0, np.int64)


#: Numbers that seven bits tell: 0 to 63, and from there on in steps of 12.8 percent, up to about 126,000.
COARSE = np.concatenate([np.arange(64), np.floor(64 * 1.128 ** np.arange(64))]).astype(np.int64)


def coarse(counts: np.ndarray) -> np.ndarray:
    """The place in COARSE of the largest number that is not over each count."""
    return np.minimum(np.searchsorted(COARSE, counts, "right") - 1, 127).astype(np.uint8)


class Dedup:
    """The steps over blocks and buckets; what they need to know travels with the object."""

    def __init__(self, length: int, gram_buckets: int, splitters: np.ndarray):
        if not TOKEN <= length <= 1 << 14:
            raise ValueError(f"length {length} is not between {TOKEN} and {1 << 14}")
        self.length, self.gram_buckets, self.splitters = length, gram_buckets, splitters

    def grams(self, runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors of a block, which of them each run has, and their buckets."""
        grams, which = np.unique(runs.gram, return_inverse=True)
        return grams, which, ((grams >> U64(32)) % U64(self.gram_buckets)).astype(np.int32)

    def ask_grams(self, block: int, table: pa.Table) -> pa.Table:
        runs = Runs(B.Texts(table), self.length)
        grams, which, bucket = self.grams(runs)
        extra = np.zeros(len(grams), np.uint8)
        if len(grams):
            low, high = np.full(len(grams), np.iinfo(np.int64).max), np.full(len(grams), np.iinfo(np.int64).min)
            np.minimum.at(low, which, runs.id)
            np.maximum.at(high, which, runs.id)
            pairs = np.unique(np.stack([which.astype(U64), runs.content()], 1).view("V16").ravel()).view(U64).reshape(-1, 2)[:, 0]
            extra = coarse(np.bincount(pairs.astype(np.int64), minlength=len(grams))) * np.uint8(2) + (low != high).astype(np.uint8)
        return B.asked(block, bucket, self.gram_buckets, grams.astype(np.uint32), extra)

    @staticmethod
    def answer_grams(table: pa.Table) -> list[bytes]:
        """0: in one document, 1: in several, 2: in several and with many surroundings."""
        keys, edges = B.joined(table["keys"], np.uint32)
        extra, _ = B.joined(table["extra"], np.uint8)
        order = np.argsort(keys, kind="stable")
        head = np.append(True, keys[order][1:] != keys[order][:-1])[: len(keys)]
        at = np.flatnonzero(head)
        sizes = np.diff(np.append(at, len(keys)))
        several = (sizes > 1) | (np.maximum.reduceat(extra[order] & 1, at) == 1)
        hot = np.add.reduceat(COARSE[extra[order] >> 1], at) > HOT
        out = np.empty(len(keys), np.uint8)
        out[order] = np.repeat(several.astype(np.uint8) * (1 + hot.astype(np.uint8)), sizes)
        return [out[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def shared(self, table: pa.Table, replies: pa.Table, texts: B.Texts) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
        """Runs whose anchor others have; each run's class of equal text, a run of the class with its lowest id, and the bucket of each class."""
        runs = Runs(texts, self.length)
        grams, which, bucket = self.grams(runs)
        code = B.unpacked(replies, bucket, self.gram_buckets, np.uint8)[which] if len(grams) else np.zeros(0, np.uint8)
        some, hot = runs.take(np.flatnonzero(code == 1)), runs.take(np.flatnonzero(code == 2)).single()
        both = object.__new__(Runs)
        both.length, both.data = runs.length, runs.data
        for name in ("start", "count", "offset", "gram", "doc", "id"):
            setattr(both, name, np.concatenate([getattr(some, name), getattr(hot, name)]))
        marks = both.content()
        order = np.lexsort((both.start, both.id, marks))
        head = np.append(True, marks[order][1:] != marks[order][:-1])[: len(marks)]
        label = np.empty(len(marks), np.int64)
        label[order] = np.cumsum(head) - 1
        best = order[head]
        return both, label, best, np.searchsorted(self.splitters, both.take(best).tokens(), "right").astype(np.int32) if len(best) else np.zeros(0, np.int32)

    def ask_texts(self, block: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        runs, _, best, bucket = self.shared(table, replies, B.Texts(table))
        order, edges = B.packed(bucket, len(self.splitters) + 1)
        runs = runs.take(best[order])
        rows: dict[str, list] = {c: [] for c in B.ASK_TYPES.names}
        for b in np.flatnonzero(np.diff(edges)):
            part = runs.take(slice(edges[b], edges[b + 1]))
            size = part.count + self.length - 1
            row = (b, block, part.id.tobytes(), (part.count | part.offset << 16).astype(np.uint32).tobytes(), runs.data[np.repeat(part.start, size) + _within(size)].tobytes())
            for c, v in zip(rows, row, strict=True):
                rows[c].append(v)
        return pa.table(rows, schema=B.ASK_TYPES)

    def answer_texts(self, table: pa.Table) -> list[bytes]:
        """For each run, bits that say which of its windows a smaller document has."""
        n = self.length
        ids, edges = B.joined(table["keys"], np.int64)
        extra, _ = B.joined(table["extra"], np.uint32)
        body, _ = B.joined(table["body"], np.uint8)
        data = np.concatenate([body, np.zeros(2 * n + 64, np.uint8)])
        count, offset = (extra & 0xFFFF).astype(np.int64), (extra >> 16).astype(np.int64)
        size = count + n - 1
        start = np.cumsum(size) - size
        depth = -(-int(size.max(initial=1)) // 8)

        def of_run(r: int, at: np.ndarray) -> np.ndarray:
            left = np.clip(size[at] - 8 * r, 0, 8)  # bytes of this key that belong to the run
            word = _words(data, start[at] + np.minimum(8 * r, size[at]))
            return np.where(left == 8, word, np.where(left == 0, U64(0), word & ~(~U64(0) >> (np.minimum(left, 7) * 8).astype(U64))))

        # Runs of different lengths may be equal as far as zeros go; the length is a key of its own.
        order, head = multikey(len(ids), depth + 1, lambda r, at: size[at].astype(U64) if r == depth else of_run(r, at))
        label, low = _lowest(order, head, ids)
        one = order[head]  # a run of each class
        grams = np.stack([_words(data, start[one] + offset[one]), _words(data, start[one] + offset[one] + 8)], 1)
        gram_order, gram_head = multikey(len(one), 2, lambda r, at: grams[at, r])
        group, _ = _lowest(gram_order, gram_head, low)
        apart = np.flatnonzero(np.bincount(group)[group] > 1) if len(one) else np.zeros(0, np.int64)
        # Windows of classes that share an anchor with another class.
        windows = np.repeat(start[one[apart]], count[one[apart]]) + _within(count[one[apart]])
        owner = np.repeat(apart, count[one[apart]])
        keys = [*range(0, n - 8, 8), n - 8]
        w_order, w_head = multikey(len(windows), len(keys), lambda r, at: _words(data, windows[at] + keys[r]))
        w_label, w_low = _lowest(w_order, w_head, low[owner])
        flags = np.zeros(int(count[one].sum()), bool)
        begin = np.cumsum(count[one]) - count[one]
        flags[np.repeat(begin[apart], count[one[apart]]) + _within(count[one[apart]])] = w_low[w_label] < low[owner] if len(windows) else False
        out = flags[np.repeat(begin[label], count) + _within(count)] | np.repeat(ids > low[label], count)
        ends = np.cumsum(np.append(0, count))[edges]
        return [np.packbits(out[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def removed(self, block: int, table: pa.Table, replies: pa.Table) -> tuple[B.Texts, np.ndarray]:
        """Which bytes of a block's texts go. replies: of both kinds, the second with buckets after the first's."""
        texts = B.Texts(table)
        second = np.asarray(replies["bucket"]) >= self.gram_buckets if replies.num_rows else np.zeros(0, bool)
        runs, label, best, bucket = self.shared(table, replies.filter(pa.array(~second)), texts)
        order, edges = B.packed(bucket, len(self.splitters) + 1)
        counts = runs.count[best]
        begin = np.cumsum(counts) - counts
        flags = np.zeros(int(counts.sum()), bool)
        texts_replies = replies.filter(pa.array(second))
        for b, raw in zip(texts_replies["bucket"].to_pylist(), texts_replies["answer"].to_pylist(), strict=True):
            at = order[edges[b - self.gram_buckets] : edges[b - self.gram_buckets + 1]]
            places = np.repeat(begin[at], counts[at]) + _within(counts[at])
            flags[places] = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(places)).astype(bool)
        later = runs.id > runs.id[best][label]
        hit = flags[np.repeat(begin[label], runs.count) + _within(runs.count)] | np.repeat(later, runs.count)
        at = (np.repeat(runs.start, runs.count) + _within(runs.count))[hit]
        total = len(texts.bytes)
        edge = np.bincount(at, minlength=total + 1)[: total + 1] - np.bincount(at + self.length, minlength=total + 1)[: total + 1]
        return texts, np.cumsum(edge[:total]) > 0

    def result(self, block: int, table: pa.Table, replies: pa.Table, keep: list[str] | None) -> pa.Table:
        texts, gone = self.removed(block, table, replies)
        begins = np.append(True, gone[1:] & ~gone[:-1]) & gone if len(gone) else gone
        rows: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for a, b in zip(texts.starts[:-1], texts.starts[1:], strict=True):
            n = int(gone[a:b].sum())
            kept = (texts.bytes[a:b][~gone[a:b]] if n else texts.bytes[a:b]).tobytes()
            rows["n_bytes"].append(b - a)
            rows["n_removed"].append(n)
            rows["n_spans"].append(int(begins[a:b].sum()) + int(n and gone[a] and not begins[a]))
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if keep is not None:
                rows["kept"].append(kept)
        out = {"doc_id": texts.doc_id, **{c: pa.array(rows[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}, "kept_sha256": pa.array(rows["kept_sha256"], pa.string())}
        if keep is not None:
            out["kept"] = pa.array(rows["kept"], pa.binary())
            out["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in rows["kept"]], pa.string())
            out |= {c: texts.table[c] for c in keep}
        return pa.table(out)


def _sample(docs: DataFrame, share: float, length: int) -> np.ndarray:
    """Leading tokens at anchors of a sample of documents, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = Runs(B.Texts(pa.Table.from_batches([batch])), length)
            some = runs.take(np.flatnonzero(runs.gram % U64(ANCHORS) == 0)).tokens()
            yield pa.RecordBatch.from_pydict({"token": pa.array(some.tolist(), pa.binary())})

    tokens = docs.select("doc_id", "text").sample(min(1.0, share), seed=5).mapInArrow(run, "token binary")
    return np.array(sorted(bytes(r["token"]) for r in tokens.collect()), dtype=f"S{TOKEN}")


def dedup(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep also kept (binary), kept_text (its whole characters) and the columns keep names."""
    sizes = docs.agg(F.sum(text_bytes())).first()
    total = int(sizes[0] or 0)
    blocks, buckets = max(16, -(-total // block_bytes)), max(8, -(-total // bucket_bytes))
    dealt = B.in_blocks(docs, blocks, keep)
    tokens = _sample(dealt, SAMPLE_BYTES / max(1, total), length)
    splitters = np.unique(tokens[np.linspace(0, len(tokens), buckets + 1).astype(int)[1:-1]]) if len(tokens) else tokens
    steps = Dedup(length, buckets, splitters)
    known = B.answer(B.ask(dealt, steps.ask_grams), steps.answer_grams)
    texts = B.answer(B.told(dealt, known, steps.ask_texts, B.ASK), steps.answer_texts)
    replies = known.union(texts.withColumn("bucket", F.col("bucket") + F.lit(buckets)))
    full = keep is not None
    made = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, kept_text string" * full)
    schema = T.StructType([*made.fields, *[dealt.schema[c] for c in keep or ()]])
    return B.told(dealt, replies, lambda b, t, r: steps.result(b, t, r, keep), schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
