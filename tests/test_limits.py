"""Token buckets by blocks against the plain fold."""

import random
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwerk.streaming import limits


def plain(times, burst, rate):
    tokens, last, out = float(burst), None, []
    for t in times:
        tokens = min(float(burst), tokens + (0.0 if last is None else (t - last) * rate))
        last = t
        out.append((t, tokens >= 1, 0.0 if tokens >= 1 else (1 - tokens) / rate))
        tokens -= 1 if tokens >= 1 else 0
    return out


def check(spark, rows, burst, rate, size):
    got = defaultdict(list)
    for r in limits.allowed(spark.createDataFrame(rows, "client string, at double").repartition(3), burst, rate, size).collect():
        got[r["client"]].append((r["at"], r["allowed"], r["retry_after"]))
    want = defaultdict(list)
    for c, t in rows:
        want[c].append(t)
    assert {c: sorted(x) for c, x in got.items()} == {c: sorted(plain(sorted(t), burst, rate)) for c, t in want.items()}


@pytest.mark.parametrize(("seed", "size"), [(0, 7), (1, 40), (2, 10_000)])
def test_clients_over_ranges(spark, seed, size):
    """Rates and times that doubles hold exactly: equal to the fold, to the last bit."""
    rng = random.Random(seed)
    rows = [(c, rng.randrange(4 * spread) / 4) for c, n, spread in (("hot", 400, 300), ("", 60, 9), (None, 50, 4000), ("slow", 30, 10**6), ("same", 90, 1)) for _ in range(n)]
    check(spark, rows, rng.choice([1, 3, 10]), rng.choice([0.25, 0.5, 2.0]), size)


def test_nothing_and_no_time(spark):
    check(spark, [], 2, 1.0, 5)
    rows = spark.createDataFrame([("a", None), ("a", 1.0), ("a", float("nan")), ("a", 1.0)], "client string, at double").withColumn("part", F.lit(1)).withColumn("tie", F.lit(1))
    got = sorted(((r["allowed"], r["retry_after"]) for r in limits.allowed(rows, 1, 0.5).collect()), key=str)
    assert got == [(False, 2.0), (False, None), (False, None), (True, 0.0)]


def test_one_client_of_a_million_requests(spark):
    """Half of them at once in time, in many ranges."""
    at = F.when(F.col("id") % 2 == 0, F.col("id") / 16).otherwise(F.floor(F.col("id") / 50_000) * 1000.0)
    rows = spark.range(1_000_000).select(F.lit("c").alias("client"), at.cast("double").alias("at"))
    out = limits.allowed(rows, 60, 0.5, 20_000)
    want = plain(sorted(r["at"] for r in rows.select("at").collect()), 60, 0.5)
    digest = lambda ok, wait: (F.count("*"), F.sum(F.when(F.col("allowed"), F.col("at"))), F.sum("retry_after"), F.count(F.when(F.col("allowed"), 1)))
    n, when, waits, many = out.agg(*digest(None, None)).first()
    assert (n, many) == (len(want), sum(ok for _, ok, _ in want)) and when == pytest.approx(sum(t for t, ok, _ in want if ok), rel=1e-12) and waits == pytest.approx(sum(w for *_, w in want), rel=1e-12)


def run(bucket, state, times):
    for t in times:
        state = max(state, t - bucket.full)
        state += bucket.one if state <= t - bucket.one else 0
    return state


@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.integers(1, 5), st.sampled_from([0.5, 1.0, 1 / 3, 7.0]), st.integers(0, 10**6))
def test_effect_of_a_block(gaps, burst, rate, back):
    """The pieces give what the fold gives, for any state before."""
    bucket = limits.Bucket(burst, rate)
    times = [sum(gaps[: k + 1]) * bucket.tick * 200_000 for k in range(len(gaps))]
    ends, values, fixed = bucket.effect(times)
    assert ends == sorted(set(ends)) and ends[-1] == times[0] and len(ends) <= 3 * burst + 4
    for state in {times[0], times[0] - back, times[0] - back * bucket.tick, times[0] - bucket.full, times[0] - bucket.full - 1, *ends, *(e + 1 for e in ends[:-1])}:
        assert bucket.after(state, ends, values, fixed) == run(bucket, state, times)
    assert bucket.after(None, ends, values, fixed) == run(bucket, times[0] - 10 * bucket.full, times)
