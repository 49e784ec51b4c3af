"""Conversation repair against plain enumeration of edits, and against a table of all nodes."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from maskwerk.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\v\f\r"
COLUMNS = [c.split()[0] for c in C.OUT.split(", ")]


def spoiled(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            row = (c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)
            out += [row] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def result(rows, marks, audit):
    """Lines that an audit makes, if roles can be given so; its cost."""
    rows, cost, slots = iter(zip(rows, marks, strict=True)), 0, []
    for letter in audit:
        if letter == "I":
            cost += 2
            slots.append((None, ""))
            continue
        (_, _, role, text), mark = next(rows)
        if letter == "D":
            cost += 3
            continue
        if mark in ("blank", "duplicate"):
            return None
        cost += (mark == "truncated") + (2 if letter == "R" else 0)
        slots.append((role if letter == "K" else None, text))
    want = ("s" if len(slots) % 2 else "") + "ua" * (len(slots) // 2)
    lines = []
    for (role, text), w in zip(slots, want, strict=True):
        if role is None and w == "s" or role is not None and role[:1] != w:
            return None
        lines.append(f"{role if role is not None else {'u': 'user', 'a': 'assistant'}[w]}:{text}")
    if not FORM.match(want):
        return None
    return cost, lines


def enumerated(rows, marks):
    """The least (cost, audit) over all audits with up to n + 1 insertions: short conversations only."""
    n, best = len(rows), None
    for inserted in range(n + 2):
        for places in itertools.combinations(range(n + inserted), inserted):
            for letters in itertools.product("KRD", repeat=n):
                it, audit = iter(letters), "".join("I" if p in places else "" for p in range(0))
                audit = "".join("I" if p in places else next(it) for p in range(n + inserted))
                got = result(rows, marks, audit)
                if got and (best is None or (got[0], audit) < (best[0], best[1])):
                    best = (got[0], audit, got[1])
    return best


def tabled(rows, marks):
    """The same by a table of the best (cost, audit) for each (rows used, state)."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                for role in "ua":
                    if role in step[state]:
                        new = (cost + 2, audit + "I")
                        if role not in best or new < best[role]:
                            best[role] = new
        return best

    best = inserted({"": (0, "")})
    for (_, _, role, _), mark in zip(rows, marks, strict=True):
        new = {}

        def take(state, value, new=new):
            if state not in new or value < new[state]:
                new[state] = value

        for state, (cost, audit) in best.items():
            take(state, (cost + 3, audit + "D"))
            if mark not in ("blank", "duplicate"):
                cost += mark == "truncated"
                if role[:1] in step[state]:
                    take(step[state][role[:1]], (cost, audit + "K"))
                for r in "ua":
                    if r in step[state]:
                        take(r, (cost + 2, audit + "R"))
        best = inserted(new)
    cost, audit = min(best[s] for s in ("", "a") if s in best)
    return cost, audit, result(rows, marks, audit)[1]


def brute(table, best=tabled):
    out, rest = {}, spoiled(table)
    for c in {r[0] for r in table}:
        rows = sorted((r for r in rest if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks, turns = faults(rows), [r[1] for r in rows if r[1] is not None]
        cost, audit, lines = best(rows, marks)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (c, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, table, best=tabled):
    got = C.repair(C.damaged(df := spark.createDataFrame(table, SCHEMA)), df).select(*COLUMNS).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    assert {r["conv_id"]: tuple(r) for r in got} == brute(table, best)


def made(seed, conversations, most, wild=True):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        n = rng.randrange(most + 1)
        for t in range(n):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", *["tool", "", None, " ", "sage", "umpire"] * wild])
            text = rng.choice(["Yes.", "No!", "Why?", "cut", "cut \n", "a. b", "", " \t", None, "Ende…", "end. ", "x" * rng.randrange(1, 9) + "."])
            rows.append((c if c or not wild else None, None if wild and rng.random() < 0.1 else t * rng.choice([1, 1, 1, 2]), role, text))
    return rows


def test_the_table_of_nodes_is_right():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(0, i, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", " ", "c!"])) for i in range(rng.randrange(4))]
        assert enumerated(rows, faults(rows)) == tabled(rows, faults(rows))


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    check(spark, made(seed, 150, 14))


def test_segments(spark, monkeypatch):
    """Conversations of many segments are put together as if searched at once."""
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(C, "SEGMENT", size)
        table = made(size, 40, 25)
        rest = spoiled(table)
        for c, want in brute(table).items():
            rows = sorted((r for r in rest if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
            talk = C.Conversation(c)
            for row, mark in zip(rows, faults(rows), strict=True):
                talk.add(*row[1:], mark)
            assert tuple(talk.result()[k] for k in COLUMNS) == want


def test_one_long_conversation(spark):
    """Half of all rows in one conversation of many segments."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["A.", "b", f"t{t}.", f"t{t}!", ""])) for t in range(3000)]
    check(spark, rows + made(9, 300, 16))


def test_nothing_and_lost_rows(spark):
    check(spark, [])
    lost = [(c, 0, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert lost
    check(spark, [*lost, (None, None, None, None), (1, None, "user", "A."), (1, 5, "assistant", "B."), (1, 5, "assistant", "B.")])


def test_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    table = made(11, 60, 8)
    df = spark.createDataFrame(table, SCHEMA).withColumns({c: F.lit(1) for c in ("kind", "time", "fault", "seen_", "said_", "audit", "cost")})
    assert {r["conv_id"]: tuple(r) for r in C.repair(C.damaged(df), df).select(*COLUMNS).collect()} == brute(table)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = C.op12_conversation_repair(spark, "/root/testdata/sf0.001").select(*COLUMNS).collect()
    assert {r["conv_id"]: tuple(r) for r in got} == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
