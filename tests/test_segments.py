"""A log of segments: chains, roots, proofs, and what is found wrong."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from maskwerk.operators import segments as G


def events(spark, first, n):
    return spark.createDataFrame([(i, *(f"{c}{i}" if c != "model_version" else None for c in G.FIELDS[:-1])) for i in range(first, first + n)], "seq long, " + ", ".join(f"{c} string" for c in G.FIELDS[:-1]))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 33])
def test_paths(n):
    hashes = [str(k) for k in range(n)]
    top = G.root(hashes)
    for k in range(n):
        way = G.path(hashes, k)
        assert G.proved(hashes[k], way, top) and not G.proved("x", way, top) and (k + 1 == n or not G.proved(hashes[k + 1], way, top))
    assert len({G.root(hashes[:k]) for k in range(n + 1)}) == n + 1


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("log") / "a")
    log = G.SegmentedLog(spark, where)
    assert log.verified().count() == 0 and log.entries().count() == 0
    for first, n in ((0, 50), (50, 3), (53, 40)):
        log.append(events(spark, first, n).repartition(3), 10)
    return where


def test_in_order_and_whole(spark, whole):
    log = G.SegmentedLog(spark, whole)
    rows = log.entries().orderBy("id").collect()
    assert [r["id"] for r in rows] == [*range(1, 94)] and [r["operation"] for r in rows] == [f"operation{i}" for i in range(93)]
    checked = log.verified().collect()
    assert all(r["ok"] for r in checked) and len(checked) > 6 and sum(r["n"] for r in checked) == 93
    for number, segment in {(r["commit"], r["segment"]) for r in checked}:
        own, way, top = log.proof(number, segment, 0)
        assert G.proved(own, way, top)


def altered(spark, whole, tmp_path, change):
    """The log with the first commit's entries changed."""
    shutil.copytree(whole, tmp_path / "b")
    log = G.SegmentedLog(spark, str(tmp_path / "b"))
    name = log.bodies()[0]["data"]
    rows = spark.createDataFrame(change(log._read(name).drop("data")).collect(), G.ENTRY)
    shutil.rmtree(tmp_path / "b" / name)
    rows.write.parquet(str(tmp_path / "b" / name))
    return {(r["commit"], r["segment"]) for r in log.verified().collect() if not r["ok"]}


def test_changes_gaps_and_swapped_segments(spark, whole, tmp_path):
    first, last = F.col("segment") == 0, F.col("segment") == 1
    cases = {
        "changed": (lambda d: d.withColumn("operation", F.when(first & (F.col("place") == 1), "other").otherwise(F.col("operation"))), {(0, 0)}),
        "gone": (lambda d: d.filter(~(last & (F.col("place") == 0))), {(0, 1)}),
        "tail gone": (lambda d: d.filter(~(last & (F.col("place") == 2))) if d.filter(last).count() > 2 else d.filter(~last), {(0, 1)}),
        "segment gone": (lambda d: d.filter(~first), {(0, 0)}),
        "swapped": (lambda d: d.withColumn("segment", F.when(first, 1).when(last, 0).otherwise(F.col("segment"))), {(0, 0), (0, 1)}),
    }
    for name, (change, want) in cases.items():
        (tmp_path / name).mkdir()
        assert altered(spark, whole, tmp_path / name, change) == want, name


def test_commits_that_go_or_change(spark, whole, tmp_path):
    shutil.copytree(whole, tmp_path / "b")
    (tmp_path / "b" / "_commits" / "000000000001.json").unlink()
    bad = {r["commit"] for r in G.SegmentedLog(spark, str(tmp_path / "b")).verified().collect() if not r["ok"]}
    assert bad == {1}


def test_writers_at_once(spark, tmp_path, monkeypatch):
    """A writer whose number is taken chains its commit behind the other's; its entries stay."""
    one, two, came = G.SegmentedLog(spark, str(tmp_path / "a")), G.SegmentedLog(spark, str(tmp_path / "a")), []
    put = one.commits.put

    def slow(number, entry):
        if not came:
            came.append(two.append(events(spark, 100, 5), 3))
        return put(number, entry)

    monkeypatch.setattr(one.commits, "put", slow)
    assert (one.append(events(spark, 0, random.Random(1).randrange(5, 20)), 4), came) == (1, [0])
    assert all(r["ok"] for r in two.verified().collect()) and two.verified().count() > 2
