r"""Repair of conversations: the cheapest edits that give roles a form, found on a lattice.

A conversation's roles, by their first letters, must read `(s?(ua)+)?`: nothing, or an optional system turn
and then pairs of user and assistant. A node of the lattice is (rows used, state of that grammar); edges
keep a row (0), set its role to user or assistant (2), delete it (3) or insert an empty turn (2), and a
truncated row that stays adds 1. Blank and repeated rows must go. Dijkstra's search takes nodes by (cost,
audit), the audit being the initials of the edits so far, so that the first accepting end that it takes is
the cheapest repair, and of equally cheap ones that with the least audit. Two audits that lead to one node
never have one cost and one in front of the other, as the letters fix the cost; so prefixes keep their
order, and a long conversation is solved in segments: each from all states to all states, then put together.

Rows come in order of conversation through one shuffle and Spark's sort. A task streams them; it holds one
segment of SEGMENT rows, and of a conversation the four best paths up to there with their digests. The
repaired conversation's SHA-256 is a fold over its text, so that one conversation is one task's stream
whatever its length. Its audit is one value: a letter for each row.

Defined results: nulls in role and text are one space (such a text is blank, such a role must be set or its
row goes); a null conv_id is a conversation of its own; null turns come first and count in no gap; rows with
the same turn come by role, then text; a role counts by its first letter, so that an empty one has none;
repeated rows beyond the first are duplicates; a conversation that has lost all rows has zeros, an empty
audit and the digest of nothing; an empty table gives no rows. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a conversation that are searched at once.
SEGMENT = 512
#: Searches that a worker keeps: conversations share their outlines.
KEPT_SEARCHES = 20_000

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
#: Letters of a role -> state behind it, by state: nothing yet, system, user, assistant.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
WRITTEN = {"u": "user", "a": "assistant"}
#: A row that must go; others are the letter of their role, x for no allowed one, in capitals where truncated.
MUST_GO = "-"

BLANK = r"[^\x20\x09-\x0D]"
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SCHEMA = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


@lru_cache(KEPT_SEARCHES)
def search(codes: str, start: int, accepting: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the best path over rows with these codes from a state to end states.

    With accepting states: to the first of them that is taken, and the search stops there. Else to all.
    """
    end, done, found = len(codes), set(), {}
    open_ = [(0, "", 0, start)]
    while open_:
        cost, audit, i, state = heapq.heappop(open_)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == end and (accepting is None or state in accepting):
            found[state] = (cost, audit)
            if accepting is not None or len(found) == len(NEXT):
                break
        steps = [(COST[INSERT], INSERT, i, NEXT[state][role]) for role in WRITTEN if role in NEXT[state]]
        if i < end:
            steps.append((COST[DELETE], DELETE, i + 1, state))
            if (code := codes[i]) != MUST_GO:
                more = TRUNCATED if code.isupper() else 0
                if code.lower() in NEXT[state]:
                    steps.append((COST[KEEP] + more, KEEP, i + 1, NEXT[state][code.lower()]))
                steps += [(COST[REROLE] + more, REROLE, i + 1, NEXT[state][role]) for role in WRITTEN if role in NEXT[state]]
        for price, letter, j, then in steps:
            if (j, then) not in done:
                heapq.heappush(open_, (cost + price, audit + letter, j, then))
    return found


class Digest:
    """SHA-256 of lines joined by line feeds, which can be copied."""

    def __init__(self, sha=None, begun: bool = False):
        self.sha, self.begun = sha or hashlib.sha256(), begun

    def after(self, rows: list[tuple[str, str]], audit: str, state: int) -> Digest:
        """This digest, with what an audit from a state makes of rows (role, text)."""
        out, at = Digest(self.sha.copy(), self.begun), iter(rows)
        for letter in audit:
            role, text = ("", "") if letter == INSERT else next(at)
            if letter == DELETE:
                continue
            if letter != KEEP:
                role = next(WRITTEN[r] for r in WRITTEN if r in NEXT[state])
            state = NEXT[state][role[:1]]
            out.sha.update(f"{chr(10) * out.begun}{role}:{text}".encode())
            out.begun = True
        return out


class Conversation:
    """Rows of one conversation, in order, as they come."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.least = self.most = self.turn = self.role = None
        self.turns = 0
        self.codes: list[str] = []
        self.rows: list[tuple[str, str]] = []
        #: By state: cost, audit and digest of the best path to the end of the last whole segment.
        self.paths: dict[int, tuple[int, str, Digest]] = {0: (0, "", Digest())}

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and (self.turns == 0 or turn != self.turn):
            self.least = turn if self.turns == 0 else self.least
            self.most = self.turn = turn
            self.turns += 1
        letter = role[:1]
        if self.role is not None and (self.role, letter) not in (("s", "u"), ("u", "a"), ("a", "u")):
            self.counts["illegal"] += 1
        self.role = letter
        if fault:
            self.counts[fault] += 1
        code = MUST_GO if fault in ("blank", "duplicate") else letter if letter and letter in "sua" else "x"
        self.codes.append(code.upper() if fault == "truncated" else code)
        self.rows.append((role, text))
        if len(self.rows) == SEGMENT:
            self.close()

    def close(self) -> None:
        """Carries the best paths over the rows that are held."""
        codes, best = "".join(self.codes), {}
        for state, (cost, audit, _) in self.paths.items():
            for end, (price, letters) in search(codes, state).items():
                if end not in best or (cost + price, audit + letters) < best[end][:2]:
                    best[end] = (cost + price, audit + letters, state, letters)
        self.paths = {end: (cost, audit, self.paths[state][2].after(self.rows, letters, state)) for end, (cost, audit, state, letters) in best.items()}
        self.codes, self.rows = [], []

    def result(self) -> dict:
        if len(self.paths) == 1:  # all rows are held: the search itself stops at the first accepting end
            ((cost, audit),) = search("".join(self.codes), 0, ACCEPTING).values()
            digest = Digest().after(self.rows, audit, 0)
        else:
            if self.rows:
                self.close()
            cost, audit, digest = min((self.paths[s] for s in ACCEPTING if s in self.paths), key=lambda p: p[:2])
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": cost, "audit": audit, "repaired_sha256": digest.sha.hexdigest()}


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation -> a row for each conversation."""
    now, done = None, []
    for batch in batches:
        for conv_id, turn, role, text, fault in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")), strict=True):
            if now is None or conv_id != now.conv_id:
                done += [now.result()] if now else []
                now = Conversation(conv_id)
            if role is not None:
                now.add(turn, role, text, fault)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, SCHEMA)
            done = []
    done += [now.result()] if now else []
    yield pa.RecordBatch.from_pylist(done, SCHEMA)


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with fault: their first, or null.

    By conversation, which the search needs too: first appearances are a window within its shuffle.
    """
    said = F.regexp_extract(F.col("text"), rf"({BLANK})[\x20\x09-\x0D]*\z", 1)
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(~F.col("text").rlike(BLANK), "blank").when(F.col("seen_") > 1, "duplicate").when(~F.col("said_").isin(".", "!", "?"), "truncated")
    return rows.repartition("conv_id").withColumns({"seen_": seen, "said_": said}).withColumn("fault", fault).drop("seen_", "said_")


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """OUT for each conversation of rows (conv_id, turn, role, text), and for those of a table of conv_ids that have no rows."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    if conversations is not None:
        # A row without a role says that a conversation is there.
        ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        rows = rows.unionByName(ids, allowMissingColumns=True)
    marked = faults(rows).select("conv_id", "turn", "role", "text", "fault")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return marked.sortWithinPartitions(*order).mapInArrow(_repair, OUT)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, damaged by the CRC-32 of `conv_id:turn` modulo 20 (nulls: one space).

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    kind: Column = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("kind", kind).filter("kind != 0").withColumns({"text": text, "role": role, "time": F.explode(times)}).drop("kind", "time")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(table), table)
