"""Matching of spans against the plain greedy loop over all pairs."""

import random

import pytest

from maskwerk.operators import scoring

SCHEMA = "doc_id long, category string, start int, end int"


def share(a, b):
    both = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    return both / ((a[1] - a[0]) + (b[1] - b[0]) - both) if a[1] > a[0] and b[1] > b[0] else 0


def plain(expected, found):
    taken, n = set(), 0
    found = sorted(found)
    for e in sorted(expected):
        best = max(((share(e, f), k) for k, f in enumerate(found) if k not in taken), default=(0, 0))
        if best[0] >= 0.5:
            taken.add(best[1])
            n += 1
    return n, len(found) - n, len(expected) - n


def check(spark, expected, found):
    got = scoring.matched(spark.createDataFrame(expected, SCHEMA), spark.createDataFrame(found, SCHEMA)).collect()
    keys = {r[:2] for r in [*expected, *found]}
    want = {k: plain([r[2:] for r in expected if r[:2] == k], [r[2:] for r in found if r[:2] == k]) for k in keys}
    assert {(r["doc_id"], r["category"]): (r["tp"], r["fp"], r["fn"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("seed", range(3))
def test_random_spans(spark, seed):
    """Many that reach into each other, equal ones, empty ones, of all lengths."""
    rng = random.Random(seed)
    span = lambda d: (d, rng.choice("XY"), (a := rng.randrange(120)), a + rng.choice([0, 1, 1, 2, 3, 4, 5, 8, 16, 31, 32, 33, 64]))
    check(spark, [span(d) for d in range(30) for _ in range(rng.randrange(14))], [span(d) for d in range(2, 32) for _ in range(rng.randrange(14))])


def test_a_document_of_100_000_spans(spark):
    rng = random.Random(1)
    expected = [(1, "X", 12 * i, 12 * i + rng.randrange(3, 12)) for i in range(100_000)]
    found = [(1, "X", max(0, s + rng.randrange(-3, 4)), e + rng.randrange(0, 5)) for _, _, s, e in expected]
    near = {}
    for k, f in enumerate(sorted(r[2:] for r in found)):
        for cell in range(f[0] // 16 - 1, f[1] // 16 + 2):
            near.setdefault(cell, []).append((k, f))
    taken, n = set(), 0
    for e in sorted(r[2:] for r in expected):
        best = max(((share(e, f), k) for k, f in near.get(e[0] // 16, ()) if k not in taken), default=(0, 0))
        if best[0] >= 0.5:
            taken.add(best[1])
            n += 1
    (row,) = scoring.matched(spark.createDataFrame(expected, SCHEMA), spark.createDataFrame(found, SCHEMA)).collect()
    assert (row["tp"], row["fp"], row["fn"]) == (n, 100_000 - n, 100_000 - n) and 50_000 < n < 100_000
