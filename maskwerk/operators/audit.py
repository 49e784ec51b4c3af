"""A hash-chained audit log: append, verify, tail, export.

An entry's hash is the SHA-256 of its seven fields joined by a pipe; it ends with the hash before it. A
chain is serial: appending a batch folds over that batch in order. Verifying is parallel: each entry is
held against the one before it, in ranges of ids, and the first of a range against the end of the range
before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GENESIS = "0" * 64
FIELDS = ["timestamp_utc", "operation", "entity_counts_json", "anonymized_text_sha256", "model_version", "recognizer_version", "prev_hash"]
LOG = "id long, " + ", ".join(f"{c} string" for c in FIELDS) + ", this_hash string"
#: Ids of one range.
RANGE = 4096


def entry_hash(prev: Column | None = None) -> Column:
    columns = [*map(F.col, FIELDS[:-1]), F.col("prev_hash") if prev is None else prev]
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in columns]), 256)


def tail(log: DataFrame) -> tuple[int, str]:
    """Id and hash of the last entry."""
    last = log.agg(F.max("id").alias("id"), F.max_by("this_hash", "id").alias("hash")).first()
    return (last["id"], last["hash"]) if last["id"] is not None else (0, GENESIS)


def append(events: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Entries for events (seq and the first six fields), in order of seq, behind the log's last.

    The chain makes this serial; it runs in one task that streams over sorted rows and holds one of them.
    """
    start, prev = tail(log) if log is not None else (0, GENESIS)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = start, prev
        for batch in batches:
            ids, before, own = [], [], []
            for row in batch[FIELDS[:-1]].itertuples(index=False):
                at += 1
                before.append(last)
                last = hashlib.sha256("|".join([*("" if pd.isna(v) else v for v in row), last]).encode()).hexdigest()
                ids.append(at)
                own.append(last)
            yield batch[FIELDS[:-1]].assign(id=ids, prev_hash=before, this_hash=own)[["id", *FIELDS, "this_hash"]]

    return events.select("seq", *FIELDS[:-1]).repartition(1).sortWithinPartitions("seq").mapInPandas(chain, LOG)


def checked(log: DataFrame) -> DataFrame:
    """id and ok: whether the entry's hash is right and follows from the entry before it."""
    part = F.floor(F.col("id") / RANGE)
    rows = log.select("id", "prev_hash", "this_hash", (entry_hash() == F.col("this_hash")).alias("right"), part.alias("part"))
    ends = rows.groupBy("part").agg(F.max_by("this_hash", "id").alias("before")).select((F.col("part") + 1).alias("p_"), "before")
    inside = F.lag("this_hash").over(Window.partitionBy("part").orderBy("id"))
    rows = rows.withColumn("inside", inside).join(ends, F.col("part") == F.col("p_"), "left")
    # Ids begin with 1; where all of a range is gone, the next one follows from nothing.
    last = F.coalesce("inside", F.when(F.col("part") == 0, F.lit(GENESIS)).otherwise(F.col("before")))
    return rows.select("id", F.coalesce(F.col("right") & (F.col("prev_hash") == last), F.lit(False)).alias("ok"))


def verify(log: DataFrame) -> bool:
    return bool(checked(log).agg(F.coalesce(F.bool_and("ok"), F.lit(True))).first()[0])


def entries(log: DataFrame) -> DataFrame:
    return log.orderBy("id")


def export_pdf(log: DataFrame, most: int = 100_000) -> bytes:
    """A PDF of the log for people: a line on the state of the chain, then the entries in order, `most` at most."""
    from maskwerk.sources.pdf import LINES, written_pdf

    rows = entries(log).select("id", "timestamp_utc", "operation", "entity_counts_json", "this_hash").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} entries: use export_csv")
    state = "The chain is whole." if verify(log) else "THE CHAIN IS BROKEN."
    lines = [f"{r['id']:>6}  {r['timestamp_utc'][:19]}  {r['operation']:<12} {r['this_hash'][:12]}  {r['entity_counts_json']}" for r in rows]
    head = ["Audit log", state, f"Entries: {len(rows)}", ""]
    return written_pdf("\n".join(head + lines[i : i + LINES - 4]) for i in range(0, max(1, len(lines)), LINES - 4))


def export_csv(log: DataFrame, path: str) -> None:
    entries(log).write.option("header", True).csv(path)
