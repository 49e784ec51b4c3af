"""Connected components against a plain union-find."""

import random

import numpy as np
import pytest

from maskwerk.operators import graph


def plain(edges):
    label = {}

    def root(x):
        label.setdefault(x, x)
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        label[max(a, b)] = min(a, b)
    return {x: root(x) for x in label}


def forest(edges):
    u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    node, root = graph.forest(u, v)
    got = dict(zip(node.tolist(), root.tolist(), strict=True))
    return {x: got.get(x, x) for e in edges for x in e}


def path(n, rng):
    order = rng.sample(range(n * 3), n)
    return [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(order, order[1:], strict=False)]


def tree(n, rng):
    names = rng.sample(range(n * 2), n)
    edges = [(names[i], names[rng.randrange(i)]) for i in range(1, n)]
    rng.shuffle(edges)
    return edges


def anything(n, rng):
    return [(a, b) for _ in range(rng.randrange(1, 2 * n)) if (a := rng.randrange(n)) != (b := rng.randrange(n))]


def test_smallest_case():
    edges = [(3, 2), (1, 4), (1, 4), (0, 5), (5, 2), (3, 4)]
    assert forest(edges) == plain(edges) == dict.fromkeys(range(6), 0)


@pytest.mark.parametrize("kind", [path, tree, anything])
def test_forest(kind):
    for seed in range(3500):
        rng = random.Random(seed)
        edges = kind(rng.choice([2, 3, 6, 20, 50]), rng)
        assert not edges or forest(edges) == plain(edges), seed


@pytest.mark.parametrize("kind", [path, tree, anything])
def test_long_ones(kind):
    edges = kind(20_000, random.Random(1))
    assert forest(edges) == plain(edges)


def test_nothing():
    none = np.zeros(0, np.int64)
    assert [len(x) for x in graph.forest(none, none)] == [0, 0]


@pytest.mark.parametrize("few", [0, graph.FEW])
@pytest.mark.parametrize("kind", [path, tree, anything])
def test_components(spark, kind, few):
    """few=0: the rounds over tables, which larger graphs take."""
    rng = random.Random(few)
    edges = [(u + 1000 * k, v + 1000 * k) for k in range(3) for u, v in kind(60, rng)] + [(5, 5), (7000, 7001), (7001, 7000)]
    got = graph.components(spark.createDataFrame(edges, "u long, v long"), few=few).collect()
    want = plain([e for e in edges if e[0] != e[1]])
    assert sorted(map(tuple, got)) == sorted(want.items())
