"""N-gram Jaccard join against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from maskwerk.llm import ngrams
from maskwerk.operators import graph

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=4):
    words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n=4, num=85, den=100):
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def check(spark, rows, **options):
    given = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, ngrams.join(given, **options).select("doc_id", "n_shingles", "component_id").collect()))
    want = brute(rows, options.get("n", 4), options.get("num", 85), options.get("den", 100))
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.mark.parametrize("which", ["docs", "crowd", "none", "sample"])
def test_tables(which, request, spark):
    check(spark, [(r["doc_id"], r["text"]) for r in request.getfixturevalue(which).collect()])


def family(seed, copies=60):
    """Chains and stars of near copies around the threshold, exact copies, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["Ab", "c", "dé", "efg", "hi", "J", "kl"]) + str(rng.randrange(60))
    rows = []
    for f in range(4):
        base = [word() for _ in range(rng.choice([5, 40, 120]))]
        for i in range(copies // 4):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = word()
            rows.append((rng.randrange(400), rng.choice([" ", "\n", " \t"]).join(text)))
            if rng.random() < 0.4:
                base = text
    return rows + [(900 + i, t) for i, t in enumerate(["one", "ONE", "one two", "two one", "", None, "a b c d", "A b  c\nd", "a b c d a b c d"])] + [(None, "one"), (None, "alone here")]


@pytest.mark.parametrize("seed", range(3))
def test_families(spark, seed):
    rows = family(seed)
    check(spark, rows)
    check(spark, rows, n=2, num=60, cluster=300)


@pytest.mark.parametrize("seed", range(2))
def test_large_clusters_are_dealt_out(spark, seed):
    """One large group of near copies of one text, chains that leave it, and others: with pivots, in many tasks, as by brute force."""
    rng = random.Random(seed)
    base, rows = [f"w{rng.randrange(500)}" for _ in range(60)], []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    chain = list(base)
    for i in range(25):
        chain[(i * 7) % 60] = f"y{i}"
        rows.append((200 + i, " ".join(chain)))
    rows += family(seed, 20)
    check(spark, rows, n=3, num=70, cluster=4000)
    check(spark, rows, n=3, num=70, cluster=900)


def test_clusters_in_memory():
    for seed in range(8):
        rng = np.random.default_rng(seed)
        sets = [np.unique(rng.integers(0, 30, rng.integers(5, 30)).astype(np.uint64)) for _ in range(80)]
        steps = ngrams.Join(4, 70, 100, 4)
        sizes, nodes = np.array([len(s) for s in sets]), rng.permutation(80).astype(np.int64)
        u, v = steps.linked(nodes, sizes, sets)
        pairs = [(nodes[i], nodes[j]) for i in range(80) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))]
        a = graph.forest(u, v)
        b = graph.forest(np.array([p for p, _ in pairs], np.int64), np.array([q for _, q in pairs], np.int64))
        assert dict(zip(*a, strict=True)) == dict(zip(*b, strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
