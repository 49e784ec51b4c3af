"""Sharding, packing and sentencepiece encoding against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from maskwerk.llm import packing, sentencepieces, sharding

WORD, PIECE = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


@pytest.mark.parametrize("which", ["docs", "crowd", "none", "sample"])
def test_sharding(which, request):
    given = request.getfixturevalue(which)
    out = sharding.shard(given, bucket_bytes=500).select("doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r["doc_id"], r["text"]) for r in given.collect())
    slots, key = defaultdict(list), {}
    for r in out:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        assert key.setdefault(r["doc_id"], r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_are_written_in_order(sample, tmp_path, spark):
    sharding.write_shards(sample, str(tmp_path / "out"), shards=3)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == sample.count() and got.select("shard").distinct().count() == 3


@pytest.mark.parametrize("which", ["docs", "crowd", "none", "sample"])
@pytest.mark.parametrize("mix", [None, {"a": 3.0, "b": 1.0}])
def test_packing(which, mix, request):
    given = request.getfixturevalue(which)
    out = packing.pack(given, WORD, length=64, sequences=8, weights=mix).collect()
    library = Tokenizer.from_file(WORD)
    library.encode_special_tokens = True
    want = Counter()
    for r in given.collect():
        want[r["doc_id"], np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    got, filled = defaultdict(list), defaultdict(list)
    for r in out:
        assert r["length"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        got[r["doc_id"], r["doc_tokens"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    whole = Counter()
    for (doc_id, total), pieces in got.items():
        by = defaultdict(list)
        for p in pieces:
            by[p["start"]].append(p["ids"])
        assert all(len(x) == len(by[0]) for x in by.values()) or len({(d) for d, _ in want if d == doc_id}) == 1
        if len(by[0]) == 1:
            ids = b"".join(by[s][0] for s in sorted(by))
            assert len(ids) == 4 * total
            whole[doc_id, ids] += 1
    assert whole == want


def test_mixture_holds_in_every_window():
    plan = packing.Schedule({"a": 1_000_003, "b": 500_001, "c": 7}, None, 10_000)
    (_, windows, starts, amounts), = plan.phases
    served = np.array([[plan.served(int(a), windows, w + 1) - plan.served(int(a), windows, w) for a in amounts] for w in range(windows)])
    assert served.sum(0).tolist() == [1_000_003, 500_001, 7] and (served.sum(1) <= 10_000).all() and served.sum(1).min() > 9_900
    assert np.ptp(served, axis=0).max() <= 1
    parts = [x for s in range(0, 500_001, 37_003) for x in plan.places("b", s, min(s + 37_003, 500_001))]
    assert sum(n for n, _, _ in parts) == 500_001


SPECIAL = ["a <|endoftext|> b", "x<|endoftext|>y", "<|ENDOFTEXT|> A <|startoftext|>B\n<|endoftext|><|endoftext|>", "<|endoftext", "plain Text, it's 12.", "", None, "<|endoftext|>", "Ünï <|endoftext|> İK"]


def test_query_has_the_ids_of_the_plain_library(spark, monkeypatch):
    given = spark.createDataFrame([(i, t, "a") for i, t in enumerate(SPECIAL)], "doc_id long, text string, source string")
    monkeypatch.setattr(packing, "documents", lambda s, d: given)
    library = Tokenizer.from_file(WORD)
    for r in packing.op3_packing(spark, "").collect():
        ids = np.array([*library.encode(SPECIAL[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]) == (0, len(ids), len(ids), zlib.crc32(ids.tobytes())), SPECIAL[r["doc_id"]]


@pytest.mark.parametrize("quoted", [False, True])
def test_special_tokens_in_any_spelling(quoted):
    """Random texts of pieces of special tokens, in other letters too, have the ids of the plain library."""
    rng = random.Random(7)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", "<|", "|>", "<", "|", ">", "endoftext", "ENDOF", "text", "A", "b", "İ", "ſ", "Ü", "É", " ", " ", "\n", ",", ".", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(10_000)]
    texts += ["A <|ENDOFTEXT|> b", "x<|EndOfText|>y"]
    library = Tokenizer.from_file(WORD)
    library.encode_special_tokens = not quoted
    mine = packing.WordTokenizer(WORD, quoted)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for t, got, want in zip(part, mine.batch(part), library.encode_batch(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, mine.kind).tolist() == want.ids, t


def shares(plan):
    """Tokens by window and queue, place by place."""
    out = defaultdict(Counter)
    for name in plan.names:
        total = sum(int(a[plan.names.index(name)]) for *_, a in plan.phases)
        for n, window, _ in plan.places(name, 0, total):
            out[window][name] += n
    return out


def test_target_proportions_by_window():
    """Deficit round-robin served token by token gives the same shares, to one token, in every window of the first phase."""
    plan = packing.Schedule({"a": 30_000, "b": 90_000, "c": 50_000}, {"a": 1.0, "b": 2.0}, 1000)
    got = shares(plan)
    first = plan.phases[0][1]
    assert first > 8
    for w in range(first):
        assert got[w]["c"] == 0 and abs(got[w]["b"] - 2 * got[w]["a"]) <= 2 and 970 <= sum(got[w].values()) <= 1000
    # A source without a weight, or with weight 0, comes last; all is served once.
    last_b = max(w for w in got if got[w]["b"])
    assert min(w for w in got if got[w]["c"]) == last_b + 1
    assert {q: sum(c[q] for c in got.values()) for q in "abc"} == {"a": 30_000, "b": 90_000, "c": 50_000}
    zero = shares(packing.Schedule({"a": 5000, "b": 9000}, {"a": 1.0, "b": 0.0}, 1000))
    assert max(w for w in zero if zero[w]["a"]) < min(w for w in zero if zero[w]["b"])


def test_tempered_shares():
    plan = packing.Schedule({"a": 10_000, "b": 1_000_000}, None, 10_000, 0.5)
    got = shares(plan)
    assert abs(got[0]["b"] / got[0]["a"] - 10) < 0.1 and sum(got[0].values()) <= 10_000


@pytest.mark.parametrize(("totals", "weights", "capacity"), [({"a": 5}, {"a": -1.0}, 100), ({"a": 5}, {"a": float("nan")}, 100), ({str(i): 9 for i in range(40)}, None, 32)])
def test_impossible_schedules(totals, weights, capacity):
    with pytest.raises(ValueError):
        packing.Schedule(totals, weights, capacity)


def test_more_sources_than_queues(spark):
    given = spark.createDataFrame([(i, f"word{i} text", f"s{i % 30}") for i in range(90)], "doc_id long, text string, source string")
    for weights in (None, {"s1": 1.0, "s2": 2.0}):
        out = packing.pack(given, WORD, length=64, sequences=8, weights=weights, queues=16).collect()
        assert {r["doc_id"] for r in out} == set(range(90)) and sum(r["length"] for r in out) == sum(r["doc_tokens"] for r in out if r["start"] == 0)
        if weights:
            of = lambda s: [r["sequence_id"] // 8 * 512 + r["sequence_id"] % 8 * 64 + r["offset"] for r in out if (r["source"] in weights) == s]
            assert max(of(True)) < min(of(False))


def test_shards_by_brute_force(spark):
    """Shard, order and slot again in plain Python, from Spark's hashes of ids."""
    import zlib as z

    from pyspark.sql import functions as F

    texts = [(i, f"text {i}" * (i % 7)) for i in range(300)]
    given = spark.createDataFrame(texts, "doc_id long, text string")
    scores = {r["doc_id"]: r["h"] for r in given.select("doc_id", F.array(*[F.xxhash64("doc_id", F.lit(s)) for s in range(6)]).alias("h")).collect()}
    total = sum(len(t) + 16 for _, t in texts)
    buckets = -(-total // (5 * 400))
    salt = given.select("doc_id", F.pmod(F.xxhash64(F.lit(17), "doc_id", F.crc32(F.col("text").cast("binary")), (F.octet_length("text") + 16).cast("long")), F.lit(buckets)).alias("b"))
    bucket = {r["doc_id"]: r["b"] for r in salt.collect()}
    groups = defaultdict(list)
    for i, t in texts:
        groups[max(range(5), key=lambda s: (scores[i][s], -s)), bucket[i]].append((i, z.crc32(t.encode()), len(t) + 16))
    want, at = {}, Counter()
    for shard, b in sorted(groups):
        rows, rng = sorted(groups[shard, b]), np.random.Generator(np.random.PCG64([17, shard, b]))
        order = np.arange(len(rows))
        rng.shuffle(order)
        for k in order:
            want[rows[k][0]] = (shard, at[shard], shard if max(scores[rows[k][0]][:5]) >= scores[rows[k][0]][5] else 5)
            at[shard] += 1
    got = {r["doc_id"]: (r["shard"], r["slot"], r["grown_shard"]) for r in sharding.shard(given, shards=5, bucket_bytes=400).collect()}
    assert got == want


def test_buckets_are_shuffled_uniformly():
    """Each place of a bucket is as likely for each row: chi-squared over many seeds."""
    import pyarrow as pa

    n, rounds = 8, 4000
    counts = np.zeros((n, n))
    for seed in range(rounds):
        table = pa.table({"shard": pa.array([0] * n, pa.int32()), "bucket": pa.array([0] * n, pa.int32()), "doc_id": pa.array(range(n))})
        out = sharding._shuffler(seed, ["doc_id"])(table)
        counts[out["doc_id"].to_numpy(), out["place"].to_numpy()] += 1
    chi = ((counts - rounds / n) ** 2 / (rounds / n)).sum()
    assert chi < 110  # 49 degrees of freedom: beyond this once in a million


@pytest.mark.parametrize("which", ["docs", "crowd", "none", "sample"])
def test_sentencepiece(which, request):
    given = request.getfixturevalue(which)
    lib = sentencepieces.loaded(PIECE).library
    want = Counter()
    for r in given.collect():
        ids = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, sentencepieces.encode(given, PIECE, full=False).collect())) == want
    full = sentencepieces.encode(given, PIECE).collect()
    coder = sentencepieces.loaded(PIECE)
    assert all(coder.decode(r["ids"]) == r["decoded"] for r in full)
