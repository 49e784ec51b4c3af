"""Suffix dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from maskwerk.llm import suffixes


def brute(rows, length=50):
    """doc_id, n_bytes, n_removed, n_spans and digest of the rest, by looking at every window."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for s in range(len(b) - length + 1):
                w = b[s : s + length]
                first[w] = min(first.get(w, i), i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for s in range(len(b) - length + 1):
                if first[b[s : s + length]] < i:
                    gone[s : s + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        out[i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def check(spark, rows, **options):
    given = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, suffixes.dedup(given, **options).collect()))
    want = brute(rows)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.mark.parametrize("which", ["docs", "crowd", "none", "sample"])
def test_tables(which, request, spark):
    rows = [(r["doc_id"], r["text"]) for r in request.getfixturevalue(which).collect()]
    check(spark, rows, bucket_bytes=100_000, block_bytes=50_000)


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_in_few_letters(spark, seed, monkeypatch):
    """Short alphabets give many partial and overlapping matches, also within a document."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab" if seed else "abcdefgh ") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(base)
            a = rng.randrange(400)
            parts.append(b[a : a + rng.randint(30, 120)])
        rows.append((rng.randint(0, 40), rng.choice(["", "ä", "zz"]).join(parts)))
    rows += [(100 + i, "a" * (40 + i)) for i in range(20)] + [(None, base[0]), (200, base[0]), (201, base[0])]
    check(spark, rows)
    monkeypatch.setattr(suffixes, "CHUNK", 257)
    monkeypatch.setattr(suffixes, "HOT", 3)
    steps = suffixes.Dedup(50, 4, np.array([b"ab", b"ba"], "S16"))
    assert local(steps, rows) == brute(rows)


def local(steps, rows, blocks=3):
    """The steps without Spark, so that a test can change their constants."""
    import pyarrow as pa

    from maskwerk.llm import blocks as B

    tables = [pa.table({"doc_id": pa.array([i for i, _ in part], pa.int64()), "text": pa.array([t for _, t in part], pa.string()), "block": pa.array([k] * len(part), pa.int32())}) for k in range(blocks) for part in [rows[k::blocks]]]

    def answers(asks, function):
        table = pa.concat_tables(asks)
        out = []
        for b in sorted(set(table["bucket"].to_pylist())):
            part = table.filter(pa.compute.equal(table["bucket"], b)).sort_by([("block", "ascending")])
            out.append(B.answered(part, function(part)))
        return pa.concat_tables(out) if out else B.answered(B.ASK_TYPES.empty_table(), [])

    of = lambda t, k: t.filter(pa.compute.equal(t["block"], k)).sort_by([("bucket", "ascending")])
    known = answers([steps.ask_grams(k, t) for k, t in enumerate(tables)], steps.answer_grams)
    texts = answers([steps.ask_texts(k, t, of(known, k)) for k, t in enumerate(tables)], steps.answer_texts)
    texts = texts.set_column(1, "bucket", pa.compute.add(texts["bucket"], pa.scalar(steps.gram_buckets, pa.int32())))
    both = pa.concat_tables([known, texts])
    out = Counter()
    for k, t in enumerate(tables):
        out.update(tuple(r.values()) for r in steps.result(k, t, of(both, k), None).to_pylist())
    return out


def test_keep(docs):
    out = suffixes.dedup(docs, keep=["lang", "source"]).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in out)
    assert Counter((r["doc_id"], r["lang"]) for r in out) == Counter((r["doc_id"], r["lang"]) for r in docs.collect())


def test_multikey_sorts():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 3, (500, 5)).astype(np.uint64)
    order, head = suffixes.multikey(500, 5, lambda r, at: keys[at, r])
    rows = list(map(tuple, keys.tolist()))
    assert [rows[i] for i in order] == sorted(rows) and head.sum() == len(set(rows))


def test_coarse_counts():
    counts = np.array([0, 1, 2, 63, 64, 65, 100, 1000, 50_000, 10**7])
    told = suffixes.COARSE[suffixes.coarse(counts)]
    assert (told <= counts).all() and (told[:4] == counts[:4]).all() and (told[:-1] >= counts[:-1] / 1.13).all() and told[-1] > suffixes.HOT
