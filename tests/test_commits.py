"""Commits of several writers: numbers, conflicts, batches that come again, two processes."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from maskwerk.operators import mapping
from maskwerk.operators.commits import Commits, Conflict

HERE = Path(__file__).resolve().parent.parent


def store(spark, path):
    return mapping.Store(spark, str(path), b"k" * 32, b"digest")


def table(spark, *rows):
    return spark.createDataFrame([(f"<EMAIL_{n:03d}>", "EMAIL", f"m{n}", f"M{n}", uses) for n, uses in rows], mapping.MAPPING)


def uses(s):
    return {r["placeholder"]: r["use_count"] for r in s.load().collect()}


def test_a_number_is_given_once(spark, tmp_path):
    log = Commits(spark, str(tmp_path / "log"))
    assert log.latest() == -1 and log.find("batch", "a") is None
    assert [log.put(0, {"batch": "a"}), log.put(0, {"batch": "b"}), log.put(1, {"batch": 'q"\n'}), log.put(3, {"batch": "a"})] == [True, False, True, True]
    assert log.latest() == 3 and log.entry(0) == {"batch": "a"} and log.find("batch", "a") == 0 and log.find("batch", 'q"\n') == 1 and log.find("batch", "b") is None
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.suffix == ".json") == ["000000000000.json", "000000000001.json", "000000000003.json"]


def test_save_does_not_write_over_others(spark, tmp_path):
    one, two = store(spark, tmp_path), store(spark, tmp_path)
    one.save(table(spark, (1, 1)))
    one.load(), two.load()
    one.save(table(spark, (1, 2)))
    with pytest.raises(Conflict):
        two.save(table(spark, (1, 9)))
    assert uses(two) == {"<EMAIL_001>": 2}
    two.save(table(spark, (1, 3)))
    assert uses(one) == {"<EMAIL_001>": 3} and one.version() == 2


def add(spark, n):
    """One more use of number n."""

    def make(known):
        old = {r["placeholder"]: r for r in known.collect()} if known is not None else {}
        name = f"<EMAIL_{n:03d}>"
        rows = [tuple(r) for p, r in old.items() if p != name] + [(name, "EMAIL", f"m{n}", f"M{n}", 1 + (old[name]["use_count"] if name in old else 0))]
        return sorted(old), spark.createDataFrame(rows, mapping.MAPPING)

    return make


def test_update_goes_on_from_what_came_between(spark, tmp_path):
    one, two, came = store(spark, tmp_path), store(spark, tmp_path), []

    def slow(known):
        if len(came) < 3:
            came.append(two.update(add(spark, 7)))
        return add(spark, 1)(known)

    assert one.update(slow) == ["<EMAIL_007>"]
    assert uses(one) == {"<EMAIL_007>": 3, "<EMAIL_001>": 1} and one.version() == 3


def test_a_batch_that_comes_again(spark, tmp_path):
    s = store(spark, tmp_path)
    docs = spark.createDataFrame([(1, 0, "a@x.at und b@x.at"), (2, 0, "a@x.at")], "doc_id long, seg_no long, text string")
    make = lambda known: mapping.anonymize(docs, known)
    first = sorted(r["anonymized"] for r in s.update(make, "5").collect())
    s.update(lambda known: mapping.anonymize(docs.limit(1), known), "6")
    before = uses(s)
    assert sorted(r["anonymized"] for r in s.update(make, "5").collect()) == first and uses(s) == before and s.version() == 1


def test_a_failed_run_changes_nothing(spark, tmp_path):
    s = store(spark, tmp_path)
    s.save(table(spark, (1, 1)))

    def broken(known):
        return None, known.withColumn("use_count", F.raise_error(F.lit("no")).cast("long"))

    with pytest.raises(Exception, match="no"):
        s.update(broken, "b")
    assert uses(s) == {"<EMAIL_001>": 1} and s.commits.find("batch", "b") is None


WRITER = """
import sys
from pyspark.sql import SparkSession
from maskwerk.operators import mapping
from tests.test_commits import add, store
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1] + "/shared").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
s = store(spark, sys.argv[1] + "/map")
for k in range(8):
    s.update(add(spark, 1 + k % 3), f"{sys.argv[2]}-{k}")
    s.update(add(spark, 1 + k % 3), f"{sys.argv[2]}-{k // 2}")
"""


def test_two_processes_lose_nothing(spark, tmp_path):
    runs = [subprocess.Popen([sys.executable, "-c", WRITER, str(tmp_path), name], cwd=HERE, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, text=True) for name in "ab"]
    for r in runs:
        _, err = r.communicate(timeout=240)
        assert r.returncode == 0, err[-2000:]
    s = store(spark, tmp_path / "map")
    assert uses(s) == {"<EMAIL_001>": 6, "<EMAIL_002>": 6, "<EMAIL_003>": 4} and s.version() == 15
