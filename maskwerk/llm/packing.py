"""Mixture-controlled packing of token streams into sequences.

Each source is a queue of its documents' ids. Deficit round-robin serves the queues window by window:
in each window a queue earns its quantum, its share of the target proportions, gets as many whole tokens
as its credit holds, and carries the fraction into the next window. The credit after w windows is a
formula of w, so any task can say where a queue's token lies, and deficits need no state that passes from
partition to partition. When a queue runs empty, the others go on by their weights: a new phase. Windows
hold 64 sequences; what a window serves is cut every `length` tokens.

Target proportions are given by source, or come from the sources' tokens: their share to the power `temper`
(1: those of the corpus; below: small sources more often, until they are used up). A source that is not
among given weights, or has weight 0, comes when all with a weight are used up, in proportion to its tokens.

Defined results: a null text is empty and gives just the end id; null sources are a queue of their own;
repeated rows each get their own pieces; an empty table gives no rows; only doc_id, source and text are
read. A special token that a text quotes, like <|endoftext|>, is taken as plain text, so that no text can end
a document; with quoted_special it gets its id, as by the library's default, which op3_packing has to match.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from maskwerk.llm.common import Resting, documents, written

LENGTH = 2048
#: Sequences in a window.
SEQUENCES = 64
END_ID = 1
#: Queues with a credit of their own; with more sources than half of that, hashes of the names without a weight share these.
QUEUES = 4096
#: Power of the sources' shares in op3_packing.
TEMPER = 0.7
#: Documents of one queue that are cut in one go, about.
RUN = 1000
#: Words that a worker keeps, about 150 bytes each; beyond that it starts anew.
KEPT_WORDS = 1_500_000
LONGEST_KEPT = 64


class WordTokenizer(Resting):
    """Ids by the tokenizers library, word by word.

    The pre-tokenizer ends every match at white space and no normalizer joins across it, so words between
    spaces and line feeds have ids of their own, and a worker keeps those it has met. New words of letters
    only are one match each; the library gets many of them as one text, whose ids fall apart at the
    tokens that end a word. A single comma or full stop behind letters is a match of its own.
    """

    def __init__(self, path: str, quoted_special: bool = False):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not quoted_special
        special = [t.content for t in self.library.get_added_tokens_decoder().values()] if quoted_special else []
        # In lower case, as a text would be looked up: where one may stand in it in any spelling, the text stays as written.
        self.special = re.compile("|".join(re.escape(t.lower()) for t in special)) if special else None
        vocab = self.library.get_vocab()
        self.kind = np.dtype("<u2") if len(vocab) <= 1 << 16 else np.dtype("<u4")
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        if not suffix:
            raise ValueError("a vocabulary with a suffix for the ends of words is needed")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def learn(self, new: list[str]) -> None:
        known, width = self.known, self.kind.itemsize
        plain = lambda w: w.isalpha() and w.islower()
        letters, marked, others = dict.fromkeys(filter(plain, new)), [], [",", "."]
        for w in new:
            if not plain(w):
                if w[-1:] in (",", ".") and plain(base := w[:-1]):
                    marked.append(w)
                    if base not in known:
                        letters[base] = None
                else:
                    others.append(w)
        words = list(letters)
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, self.kind)
            ends, raw, start = (np.flatnonzero(self.ends[ids]) + 1) * width, ids.tobytes(), 0
            if len(ends) != len(part):  # a letter that a normalizer takes apart
                others += part
                continue
            for w, end in zip(part, ends.tolist(), strict=True):
                known[w] = raw[start:end]
                start = end
        for at in range(0, len(others), 5000):
            part = others[at : at + 5000]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, self.kind).tobytes()
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1]]

    def words(self, text: str) -> list[str]:
        try:  # where lower case cannot depend on neighbours or on composition, it is taken before the look-up
            text.encode("latin-1")
            low = text.lower()
            # A special token counts only as it is written: lower case must not make one.
            if low == text or not (self.special and self.special.search(low)):
                text = low
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ").split(" ")

    def batch(self, texts: list[str]) -> list[bytes]:
        known = self.known = self.known.renewed(KEPT_WORDS)
        # One look-up for each word; those not met yet stand for themselves until they are learnt.
        parts = [list(map(known.__getitem__, self.words(t))) for t in texts]
        new = [*known.missed]
        known.missed.clear()
        self.learn(new)
        out = [b"".join([x if type(x) is bytes else known[x] for x in p]) for p in parts]
        for w in new:
            if len(w) > LONGEST_KEPT:
                del known[w]
        return out


_loaded: dict[tuple[str, bool], WordTokenizer] = {}


def loaded(path: str, quoted_special: bool = False) -> WordTokenizer:
    if (path, quoted_special) not in _loaded:
        _loaded[path, quoted_special] = WordTokenizer(path, quoted_special)
    return _loaded[path, quoted_special]


def tokenize(docs: DataFrame, tokenizer: str, quoted_special: bool = False) -> DataFrame:
    """doc_id, source, n_tokens (without the end id) and ids (little-endian, 2 bytes each, or 4 for large vocabularies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = loaded(tokenizer, quoted_special)
        with words.awake():
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    ids = words.batch([t or "" for t in part["text"].to_pylist()])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": part["doc_id"], "source": part["source"],
                        "n_tokens": pa.array([len(x) // words.kind.itemsize for x in ids], pa.int64()),
                        "ids": pa.array(ids, pa.binary()),
                    })

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(source as string) as source", "text").mapInArrow(run, "doc_id long, source string, n_tokens long, ids binary")


class Schedule:
    """Phases of deficit round-robin over queues with given totals and weights.

    A phase lasts until a queue is empty; in it queue q gives `amount[q]` tokens over `windows` windows, of
    which floor(amount * w / windows) come before window w. A window holds at most `capacity` tokens.
    """

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None, capacity: int, temper: float = 1.0):
        self.names = sorted(q for q in totals if totals[q])
        given = weights or {}
        if any(not (0 <= w < float("inf")) for w in given.values()):
            raise ValueError("weights are finite and not negative")
        if capacity <= 2 * len(self.names):
            raise ValueError(f"a window of {capacity} tokens for {len(self.names)} queues: it must hold more than two of each")
        first = [q for q in self.names if given.get(q)]
        whole = sum(totals[q] for q in self.names)
        own = lambda q: Fraction(totals[q]) if temper == 1 else Fraction((totals[q] / whole) ** temper).limit_denominator(1 << 32) or Fraction(1, 1 << 32)
        weight = {q: Fraction(given[q]) if given.get(q) else own(q) for q in self.names}
        left = {q: totals[q] for q in self.names}
        self.phases, at, window = [], dict.fromkeys(self.names, 0), 0
        while active := [q for q in first if left[q]] or [q for q in self.names if left[q]]:
            turns = min(left[q] / weight[q] for q in active)
            amount = {q: min(left[q], max(1, int(turns * weight[q]))) if q in active else 0 for q in self.names}
            # A queue's floor may be one over its mean in any window; room for that keeps every window within its capacity.
            windows = -(-sum(amount.values()) // (capacity - len(active)))
            amounts, starts = (np.array([x[q] for q in self.names], np.int64) for x in (amount, at))
            self.phases.append((window, windows, starts, amounts))
            window += windows
            for q in active:
                left[q] -= amount[q]
                at[q] += amount[q]

    @staticmethod
    def served(amount, windows: int, w):
        """floor(amount * w / windows) without overflow."""
        whole, rest = divmod(amount, windows)
        return whole * w + rest * w // windows

    def places(self, name: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(tokens, window, offset in the window) of the parts of a queue's tokens [start, end)."""
        k = self.names.index(name)
        for window, windows, starts, amounts in self.phases:
            lo, hi, total = int(starts[k]), int(starts[k] + amounts[k]), int(amounts[k])
            while lo <= start < min(hi, end):
                p = start - lo
                w = min(p * windows // total, windows - 1)
                while self.served(total, windows, w) > p:
                    w -= 1
                while self.served(total, windows, w + 1) <= p:
                    w += 1
                first = self.served(total, windows, w)
                n = min(self.served(total, windows, w + 1), hi - lo, end - lo) - p
                before = amounts[:k]
                ahead = int((self.served(before, windows, w + 1) - self.served(before, windows, w)).sum())
                yield n, window + w, ahead + p - first
                start += n


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, sequences: int = SEQUENCES, end_id: int = END_ID, weights: dict[str, float] | None = None, queues: int = QUEUES, temper: float = 1.0, quoted_special: bool = False) -> DataFrame:
    """Pieces: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, 4 bytes each).

    weights: target proportions by source, for `queues` / 2 of them at most; without, the shares of the corpus
    to the power temper. The totals by queue go to the driver; there are `queues` of them at most.
    """
    if weights and len(weights) > queues // 2:
        raise ValueError(f"target proportions for more than {queues // 2} sources")
    tokens = written(tokenize(docs, tokenizer, quoted_special), "tokens")
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    if tokens.select("source").distinct().limit(queues // 2 + 1).count() > queues // 2:
        hashed = F.concat(F.lit("h"), F.pmod(F.xxhash64("source"), F.lit(queues // 2)).cast("string"))
        name = F.when(F.col("source").isin(*weights), name).otherwise(hashed) if weights else hashed
    tokens = tokens.withColumn("queue", name)
    # A row for each queue, `queues` at most: how many runs its documents are split into.
    runs = tokens.groupBy("queue").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    tokens = tokens.join(F.broadcast(runs), "queue").withColumn("run", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.col("runs")).cast("int"))
    sums = tokens.groupBy("queue", "run").agg(F.sum(F.col("n_tokens") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("queue").alias("q_"), F.col("run").alias("r_"), before.alias("before"))
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    schedule = Schedule(totals, weights and {f"s{k}": v for k, v in weights.items()}, sequences * length, temper)
    wide = loaded(tokenizer).kind.itemsize == 4

    def cut(key, left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = key[0].as_py()
        table = pa.Table.from_batches(left).sort_by([("doc_id", "ascending"), ("n_tokens", "ascending"), ("ids", "ascending")])
        at = pa.Table.from_batches(right)["before"][0].as_py()
        out: dict[str, list] = {c: [] for c in ("doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
        for doc_id, source, ids in zip(*(table[c].to_pylist() for c in ("doc_id", "source", "ids")), strict=True):
            whole = np.append(np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4"), np.array([end_id], "<u4"))
            start, total = 0, len(whole)
            for n, window, place in schedule.places(queue, at, at + total):
                while n:
                    size = min(n, length - place % length)
                    piece = whole[start : start + size].tobytes()
                    row = (doc_id, source, start, size, zlib.crc32(piece), total, window * sequences + place // length, place % length, piece)
                    for c, v in zip(out, row, strict=True):
                        out[c].append(v)
                    start, place, n = start + size, place + size, n - size
            at += total
        kinds = (pa.int64(), pa.string(), *[pa.int64()] * 6, pa.binary())
        yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})

    pieces = tokens.groupBy("queue", "run").cogroup(starts.groupBy("q_", "r_"))
    return pieces.applyInArrow(lambda key, a, b: pa.Table.from_batches(cut(key, a.to_batches(), b.to_batches())), "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), temper=TEMPER, quoted_special=True).drop("ids")
