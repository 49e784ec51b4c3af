"""Ranked search against plain scoring of all documents."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from maskwerk.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    """Rows (item_id, rank, doc_id, score), sorted."""
    words = [(d, w) for d, t in docs if (w := terms(t))]
    n, total = len(words), sum(len(w) for _, w in words)
    counts, df = [], {}
    for _, w in words:
        c = {}
        for t in w:
            c[t] = c.get(t, 0) + 1
        counts.append(c)
        for t in c:
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        own, scores = set(terms(text)), []
        for (d, w), c in zip(words, counts, strict=True):
            m = 50 + (50 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def check(spark, docs, items, k=50, parts=3, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    q = spark.createDataFrame(items, "item_id long, text string")
    search = {o: options.pop(o) for o in ("block_terms",) if o in options}
    got = L.search(L.index(d, **options), q, k, **search)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


def made(seed, n=300):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Der", "die", "DAS", "über", "Ärger", "x", "2024", "naïve", "梦", "a_b", "w{}w"]) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.6)) % 400}"
    docs = [(i, rng.choice([" ", "\n", "-", "\t"]).join(word() for _ in range(rng.choice([0, 1, 5, 30, 200])))) for i in range(n)]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 4, 20])))) for i in range(12)]
    return docs + [(d + 1000, t) for d, t in docs[::3]], items


@pytest.mark.parametrize(("k", "size"), [(50, 1 << 24), (3, 2000), (1, 1)])
def test_random_texts(spark, k, size):
    docs, items = made(k)
    check(spark, docs, items, k, shard_bytes=size)


def test_queries_in_blocks(spark):
    docs, items = made(7, 60)
    check(spark, docs, items, 5, block_terms=30)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "... !"), (None, "alpha beta"), (None, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (5, "ALPHA alpha Ä ä"), (6, "alpha " * 20_000 + "end"), (7, "é\u0000é x"), (-3, "alpha beta")]
    items = [(1, "alpha"), (1, "Alpha beta beta"), (None, "end ä"), (2, None), (3, "  "), (4, "nowhere"), (5, "É é Ä x")]
    check(spark, docs, items)
    check(spark, docs, items, 2, parts=1)


def test_empty_tables(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a b")], [])
    check(spark, [(1, None)], [(1, "a")])


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs, items = made(5, 40)
    more = {c: F.lit(1) for c in ("shard", "term", "df", "tokens", "postings", "score", "rank", "query", "words", "q_")}
    d, q = (spark.createDataFrame(r, f"{c} long, text string").withColumns(more) for r, c in ((docs, "doc_id"), (items, "item_id")))
    assert sorted(map(tuple, L.search(L.index(d), q).collect()), key=str) == brute(docs, items)


def test_given_tables(spark):
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").select(c, "text").collect()]
    got = L.op13_lexical_search(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=str) == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


@given(st.lists(st.integers(0, 2**62)))
def test_varints(values):
    data, ends = L.varints(np.array(values, np.int64))
    assert L.numbers(data.tobytes()).tolist() == values
    assert len(ends) == len(values) and (not values or ends[-1] == len(data))


@given(st.lists(st.dictionaries(st.integers(0, 40), st.integers(0, 9), min_size=1), min_size=1, max_size=6), st.integers(1, 8))
def test_best(lists, k):
    """Pruning loses nothing, whatever the ties."""
    scores = {}
    for x in lists:
        for d, s in x.items():
            scores[d] = scores.get(d, 0) + s
    want = sorted((-s, d) for d, s in scores.items() if s)[:k]
    got = L.best([L.Postings(np.array(sorted(x)), np.array([x[d] for d in sorted(x)])) for x in lists], k)
    assert sorted((-s, d) for s, d in got) == want
