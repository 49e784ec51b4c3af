"""Overlaps in long chains against the plain loop."""

import random
import time

import pytest
from pyspark.sql import functions as F

from maskwerk.operators import spans as S

COLUMNS = "start int, end int, category string, text string, score double, ord int"


def plain(spans):
    out = []
    for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1], -s[4], s[5])):
        if out and s[0] < out[-1][1]:
            if (s[1] - s[0], s[4]) > (out[-1][1] - out[-1][0], out[-1][4]):
                out[-1] = s
        else:
            out.append(s)
    return out


def resolved(spark, many):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(many)], f"i int, s array<struct<{COLUMNS.replace(' ', ':').replace(',:', ',')}>>")
    return {r["i"]: [tuple(s) for s in r["s"]] for r in df.select("i", S.resolve(F.col("s")).alias("s")).collect()}


@pytest.mark.parametrize("reach", [2, 5, 40])
def test_chains(spark, reach):
    rng = random.Random(reach)
    many = [[(a := rng.randrange(3 * n), a + rng.randrange(1, reach), "X", "", rng.choice([0.5, 0.9]), rng.randrange(3)) for _ in range(n)] for n in [0, 1, 2, 3, 5, 9, 10, 17, 60, 200] * 4]
    assert resolved(spark, many) == {i: plain(s) for i, s in enumerate(many)}


def test_one_chain_of_100_000(spark):
    """Each span reaches into the next; the second half grows so that each takes the place of the one before."""
    some = [(2 * i, 2 * i + 3, "X", "", 0.5, 0) for i in range(50_000)] + [(100_000 + i, 100_010 + 2 * i, "X", "", 0.5, 0) for i in range(50_000)]
    started = time.monotonic()
    assert resolved(spark, [some]) == {0: plain(some)}
    assert time.monotonic() - started < 120
