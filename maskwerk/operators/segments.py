"""An audit log of segments, which many writers append to and many tasks hash.

A batch of events is cut into ranges of its order; each range is a segment, a hash chain of its own, made by one task,
with a Merkle root over its entries. A commit lists the roots of a batch's segments in order and is chained to
the commit before it: root = SHA-256 of the root before and these. So writers meet only in that one small step, and
a writer that comes second chains its commit anew without touching its entries. What is changed, missing, added or
moved within a segment changes its root; segments that change places, and commits that go, break the chain of
roots. One entry is proved by its path: the digests beside it up to its segment's root.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwerk.operators.audit import FIELDS, GENESIS
from maskwerk.operators.commits import Commits, Conflict
from maskwerk.operators.mapping import RANGE_ROWS, ranged

ENTRY = "segment int, place long, " + ", ".join(f"{c} string" for c in FIELDS) + ", this_hash string"
ATTEMPTS = 50


def _digest(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def levels(hashes: Sequence[str]) -> list[list[str]]:
    """A Merkle tree from its leaves up; leaves and nodes are hashed apart, a node without a neighbour goes up as it is."""
    out = [[_digest("leaf", h) for h in hashes]]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([_digest("node", *row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    return out


def root(hashes: Sequence[str]) -> str:
    return levels(hashes)[-1][0] if hashes else GENESIS


def path(hashes: Sequence[str], place: int) -> list[tuple[str, bool]]:
    """Digests beside an entry on the way up, and whether each stands on the left."""
    out = []
    for row in levels(hashes)[:-1]:
        beside = place ^ 1
        if beside < len(row):
            out.append((row[beside], beside < place))
        place //= 2
    return out


def proved(this_hash: str, way: Sequence[tuple[str, bool]], segment_root: str) -> bool:
    """Whether an entry with this hash belongs to a segment with that root."""
    now = _digest("leaf", this_hash)
    for beside, left in way:
        now = _digest("node", beside, now) if left else _digest("node", now, beside)
    return now == segment_root


def chained(rows: pd.DataFrame) -> pd.DataFrame:
    """Entries of one segment's events, in order of seq."""
    rows, last, before, own = rows.sort_values("seq", kind="stable"), GENESIS, [], []
    for fields in rows[FIELDS[:-1]].itertuples(index=False):
        before.append(last)
        last = _digest(*("" if pd.isna(v) else v for v in fields), last)
        own.append(last)
    return rows.assign(segment=rows["part"], place=range(len(rows)), prev_hash=before, this_hash=own)[["segment", "place", *FIELDS, "this_hash"]]


def judged(rows: pd.DataFrame) -> pd.DataFrame:
    """n, root and whole (each entry's hash is right and follows from the one before) of one segment."""
    rows, last, whole = rows.sort_values("place"), GENESIS, True
    for k, entry in enumerate(rows[["place", *FIELDS, "this_hash"]].itertuples(index=False)):
        fields = entry[1:-2]
        whole &= entry.place == k and entry.prev_hash == last and entry.this_hash == _digest(*("" if pd.isna(v) else v for v in fields), last)
        last = entry.this_hash
    return pd.DataFrame({"data": rows["data"].iloc[:1], "segment": rows["segment"].iloc[:1], "n": len(rows), "root": root([h or "" for h in rows["this_hash"]]), "whole": whole})


class SegmentedLog:
    """A log in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, f"{self.path}/_commits")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/{name}").withColumn("data", F.lit(name))

    def append(self, events: DataFrame, size: int = RANGE_ROWS) -> int:
        """Adds events (seq and the fields of an entry) in segments of about `size`; the commit's number."""
        name = f"entries-{uuid.uuid4().hex}"
        ranged(events.select("seq", *FIELDS[:-1]), ["seq", *FIELDS[:-1]], size).groupBy("part").applyInPandas(chained, ENTRY).write.parquet(f"{self.path}/{name}")
        made = self._read(name).groupBy("data", "segment").applyInPandas(judged, "data string, segment int, n long, root string, whole boolean")
        # A row for each segment: the batch's events divided by `size`.
        segments = [[r["segment"], r["n"], r["root"]] for r in sorted(made.collect(), key=lambda r: r["segment"])]
        for _ in range(ATTEMPTS):
            number = self.commits.latest() + 1
            before = json.loads(self.commits.entry(number - 1)["body"])["root"] if number else GENESIS
            body = {"data": name, "segments": segments, "before": before, "root": _digest(before, *(r for _, _, r in segments))}
            if self.commits.put(number, {"body": json.dumps(body)}):
                return number
        raise Conflict(self.path)

    def bodies(self) -> list[dict]:
        """Commits in order: a row for each batch, not for each entry."""
        last = self.commits.latest()
        if last < 0:
            return []
        rows = self.spark.read.option("pathGlobFilter", "[0-9]*.json").text(f"{self.path}/_commits").select(F.col("_metadata.file_name").alias("n"), "value").collect()
        return [json.loads(json.loads(r["value"])["body"]) for r in sorted(rows, key=lambda r: r["n"])]

    def entries(self) -> DataFrame:
        """All entries with their commit and id, from 1 in order of commits, segments and places."""
        starts, at = [], 1
        for number, body in enumerate(self.bodies()):
            for segment, n, _ in body["segments"]:
                starts.append((body["data"], segment, number, at))
                at += n
        known = self.spark.createDataFrame(starts, "d_ string, s_ int, commit long, first long")
        names = sorted({s[0] for s in starts})
        if not names:
            return self.spark.createDataFrame([], f"{ENTRY}, data string, commit long, id long")
        rows = self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/{n}" for n in names]).withColumn("data", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        # A row for each segment: RANGE_ROWS times fewer than entries.
        return rows.join(known, (F.col("data") == F.col("d_")) & (F.col("segment") == F.col("s_"))).withColumn("id", F.col("first") + F.col("place")).drop("d_", "s_", "first")

    def verified(self) -> DataFrame:
        """commit, segment, n and ok: whether each segment is as its commit says, and its commit follows from the one before."""
        told, before = [], GENESIS
        for number, body in enumerate(self.bodies()):
            follows = body["before"] == before and body["root"] == _digest(before, *(r for _, _, r in body["segments"]))
            told += [(number, body["data"], segment, n, r, follows) for segment, n, r in body["segments"]]
            before = body["root"]
        known = self.spark.createDataFrame(told, "commit long, d_ string, s_ int, n long, r_ string, follows boolean")
        if not told:
            return known.select("commit", F.col("s_").alias("segment"), "n", F.col("follows").alias("ok"))
        rows = self.entries().select("data", "segment", "place", *FIELDS, "this_hash")
        seen = rows.groupBy("data", "segment").applyInPandas(judged, "data string, segment int, n long, root string, whole boolean").withColumnRenamed("n", "m_")
        both = known.join(seen, (F.col("d_") == F.col("data")) & (F.col("s_") == F.col("segment")), "left")
        ok = F.coalesce(F.col("whole") & (F.col("root") == F.col("r_")) & (F.col("m_") == F.col("n")), F.lit(False)) & F.col("follows")
        return both.select("commit", F.col("s_").alias("segment"), "n", ok.alias("ok"))

    def proof(self, number: int, segment: int, place: int) -> tuple[str, list[tuple[str, bool]], str]:
        """Hash, path and segment root of an entry, from its segment alone."""
        body = json.loads(self.commits.entry(number)["body"])
        rows = self._read(body["data"]).filter(F.col("segment") == segment).select("place", "this_hash").orderBy("place").collect()
        hashes = [r["this_hash"] for r in rows]
        return hashes[place], path(hashes, place), dict((s, r) for s, _, r in body["segments"])[segment]
