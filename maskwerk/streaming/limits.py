"""Token buckets over requests, where one client's requests may be many tasks' work.

Requests are put in ranges of client and time. A client within one range is folded there, in doubles. One that
goes over ranges is settled by blocks, its part of each range: a block's effect is a function of the state at its
start, and such functions are put together in order, so that each block knows its state and is folded by itself.

The state is the time z at which the bucket would have been empty had it filled at its rate ever since, in units
in which all numbers are integers. A request at time t fills the bucket at most (z is at least t - full), then
takes one token if there is one (z grows by one token's time if z <= t - one). So a block's function is made of
few pieces, each a shift (so many tokens taken, the bucket never full) or a constant (it was full meanwhile); a
request moves a piece, cuts one, or makes neighbours equal. States before a block lie in a range of `full`, so
that there are some pieces for each token of the bucket at most, and two or three once a request has been refused.

Defined results: requests at one time come in any order, which makes no difference but for which of them is
which; a null client is a client; a request without a time is refused, waits for null and takes nothing. The state at a
block's start is exact, so that the rounding of a fold in doubles ends there; times count in microseconds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwerk.operators.mapping import RANGE_ROWS, ranged

OUT = "client string, at double, allowed boolean, retry_after double"
MICRO = 1_000_000


class Bucket:
    """Sizes in integers: a microsecond's worth, one token's, a full bucket's."""

    def __init__(self, burst: int, rate: float):
        if burst < 1 or not rate > 0:
            raise ValueError("a bucket holds a token and fills")
        share = Fraction(rate).limit_denominator(MICRO)
        self.tick, self.one = share.numerator, share.denominator * MICRO
        self.full = burst * self.one
        self.burst, self.rate = burst, rate

    def times(self, at: np.ndarray) -> list[int]:
        return [t * self.tick for t in np.rint(at * MICRO).astype(np.int64).tolist()]

    def effect(self, times: list[int]) -> tuple[list[int], list[int], list[bool]]:
        """Upper ends of pieces of the states before a block, and each piece's shift, or its constant."""
        one, full = self.one, self.full
        ends, values, fixed = [times[0]], [0], [False]
        for t in times:
            low, high = t - full, t - one
            if len(ends) == 1 and fixed[0]:
                value = max(values[0], low)
                values[0] = value + one if value <= high else value
                continue
            new_ends: list[int] = []
            new_values: list[int] = []
            new_fixed: list[bool] = []
            start = None
            for end, value, constant in zip(ends, values, fixed, strict=True):
                if constant:
                    value = max(value, low)
                    parts = ((end, value + one if value <= high else value, True),)
                else:
                    parts = ((low - value, low + one, True), (high - value, value + one, False), (end, value, False))
                for upper, after, kind in parts:
                    upper = min(upper, end)
                    if start is not None and upper <= start:
                        continue
                    if new_values and new_values[-1] == after and new_fixed[-1] == kind:
                        new_ends[-1] = upper
                    else:
                        new_ends.append(upper)
                        new_values.append(after)
                        new_fixed.append(kind)
                    start = upper
            ends, values, fixed = new_ends, new_values, new_fixed
        return ends, values, fixed

    @staticmethod
    def after(state: int | None, ends: list[int], values: list[int], fixed: list[bool]) -> int:
        """The state behind a block; None before it: a full bucket."""
        k = 0 if state is None else min(bisect_left(ends, state), len(ends) - 1)
        return values[k] if fixed[k] else state + values[k]

    def fold(self, at: list[float], tokens: float) -> tuple[list[bool], list[float]]:
        """Decisions in order, from so many tokens at the first request."""
        burst, rate, last, ok, wait = float(self.burst), self.rate, at[0], [], []
        for t in at:
            tokens = min(burst, tokens + (t - last) * rate)
            last = t
            if tokens >= 1:
                ok.append(True)
                wait.append(0.0)
                tokens -= 1
            else:
                ok.append(False)
                wait.append((1 - tokens) / rate)
        return ok, wait


def by_client(rows: pd.DataFrame) -> Iterator[tuple[str | None, np.ndarray]]:
    """Each client's times, in order."""
    for client, group in rows.groupby("client", dropna=False, sort=False):
        yield client if isinstance(client, str) else None, np.sort(group["at"].to_numpy(float))


def allowed(requests: DataFrame, burst: int = 60, rate: float = 1.0, size: int = RANGE_ROWS) -> DataFrame:
    """Decisions over requests (client, at in seconds): allowed and retry_after. size: requests of one range, about."""
    bucket = Bucket(burst, rate)
    rows = requests.select(F.col("client").cast("string").alias("client"), F.col("at").cast("double").alias("at"))
    timeless = rows.filter("at is null or isnan(at)").select("client", "at", F.lit(False).alias("allowed"), F.lit(None).cast("double").alias("retry_after"))
    # Requests of one client at one time are told apart, so that any number of them can be several ranges.
    rows = ranged(rows.filter("at is not null and not isnan(at)").withColumn("tie", F.monotonically_increasing_id()), ["client", "at", "tie"], size)
    blocks = rows.groupBy("client", "part").agg(F.min("at").alias("first"))
    over = blocks.groupBy(F.col("client").alias("c_")).agg(F.count("*").alias("n")).filter("n > 1")
    long = rows.join(over, F.col("client").eqNullSafe(F.col("c_")), "left_semi").select("client", "part", "at")

    def effects(group: pd.DataFrame) -> pd.DataFrame:
        """What a block does, as text: integers may be of any length."""
        times = bucket.times(np.sort(group["at"].to_numpy(float)))
        ends, values, fixed = bucket.effect(times)
        told = lambda xs: " ".join(map(str, xs))
        return pd.DataFrame([(group["client"].iloc[0], group["part"].iloc[0], times[0], told(ends), told(values), told(map(int, fixed)))], columns=["client", "part", "first", "ends", "values", "fixed"]).astype({"first": str})

    def states(group: pd.DataFrame) -> pd.DataFrame:
        """Tokens at the first request of each block of a client; a row for each block comes here."""
        state, out = None, []
        listed = lambda s: [int(x) for x in s.split()]
        for r in group.sort_values("part").itertuples():
            first = int(r.first)
            out.append((r.client, r.part, float(bucket.burst) if state is None else min(bucket.full, first - state) / bucket.one))
            state = bucket.after(state, listed(r.ends), listed(r.values), [bool(x) for x in listed(r.fixed)])
        return pd.DataFrame(out, columns=["client", "part", "tokens"])

    known = long.groupBy("client", "part").applyInPandas(effects, "client string, part int, first string, ends string, values string, fixed string")
    known = known.groupBy("client").applyInPandas(states, "client string, part int, tokens double")

    def decided(group: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        tokens = {c if isinstance(c, str) else None: x for c, x in zip(starts["client"], starts["tokens"], strict=True)}
        out = [pd.DataFrame({"client": pd.Series([], dtype=object), "at": np.zeros(0), "allowed": np.zeros(0, bool), "retry_after": np.zeros(0)})]
        for client, at in by_client(group):
            ok, wait = bucket.fold(at.tolist(), tokens.get(client, float(burst)))
            out.append(pd.DataFrame({"client": [client] * len(at), "at": at, "allowed": ok, "retry_after": wait}))
        return pd.concat(out)

    done = rows.select("client", "at", "part").groupBy("part").cogroup(known.groupBy("part")).applyInPandas(decided, OUT)
    return done.unionByName(timeless)
