"""Near spellings of companies, merged in order of appearance without a fold over all of them.

A key joins the first accepted key before it that it may merge with, or is accepted itself; so the accepted
keys are the lexicographically first independent set of the graph of near names. Two names are neighbours if
they have the same category, legal form and letters, or cores one edit apart. Neighbours meet in hubs, of which
a name has some for each letter of its core, and no pairs are made: in hubs of equal letters, and of cores that
are equal but for the letter at one place, all are neighbours; in hubs of a core, those that have it and those
that have it but for one letter more.

Rounds settle keys: one with an accepted neighbour before it is out; one with no open neighbour before it is
accepted; one with a single open neighbour before it is what that one is not, which chains of such keys pass
on by doubling reach. Hubs are summed to the least keys in them, so that large hubs shrink before the shuffle.
Keys come in no order that names have, so that rounds are few; long chains in order are one round.

Keys are numbers in order, and rounds are made in as many parts as there are places in hubs, so that a task's
memory stays the same: these rows are compressed so well that parts of Spark's usual size would hold millions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwerk.functions import text as X
from maskwerk.plans.tables import in_parts, written

#: Places in hubs that one task may hold, about 100 bytes each; more are settled in rounds.
FEW = 200_000
#: Names, and places in hubs, of one task of a round, about.
NAMES, PLACES = 10_000, 250_000

#: Part of a name in a hub: with all others, with those that lack a letter of it, with those that have a letter more.
ALL, LONG, SHORT = 0, 1, 2
OTHERS = {ALL: ALL, LONG: SHORT, SHORT: LONG}
OPEN, ACCEPTED, OUT = 0, 1, 2


def within_one(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def greedy(cores: list[str], letters: list[str]) -> list[int]:
    """For each name in order, the place of the accepted one that it counts as.

    Accepted names are looked up by their letters and by what is left of their core without any one letter:
    two cores within one edit have one of these in common.
    """
    by_letters: dict[str, int] = {}
    by_variant: dict[str, list[int]] = {}
    into = []
    for k, (core, bare) in enumerate(zip(cores, letters, strict=True)):
        variants = {core, *(core[:i] + core[i + 1 :] for i in range(len(core)))}
        found = [by_letters[bare]] if bare in by_letters else []
        for j in {j for v in variants for j in by_variant.get(v, ())}:
            if max(len(core), len(cores[j])) >= X.FUZZY_LEAST and within_one(core, cores[j]):
                found.append(j)
        into.append(min(found, default=k))
        if not found:
            by_letters.setdefault(bare, k)
            for v in variants:
                by_variant.setdefault(v, []).append(k)
    return into


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """into for all names that come, which is in order; by category and form."""
    rows = pd.concat([pd.DataFrame(columns=["category", "form", "normal", "core", "letters"]), *batches])
    parts = [rows[:0].assign(into="")[["category", "normal", "into"]]]
    for _, group in rows.groupby(["category", "form"]):
        names = group["normal"].tolist()
        into = [names[k] for k in greedy(group["core"].tolist(), group["letters"].tolist())]
        parts.append(pd.DataFrame({"category": group["category"].to_numpy(), "normal": names, "into": into}))
    yield pd.concat(parts)


def hubs() -> Column:
    """Structs of hub and role for each hub that a name (category, form, core, letters) is in."""
    core, letters = F.col("core"), F.col("letters")
    of = lambda *x: F.concat_ws("\x01", F.col("category"), F.col("form"), *x)
    place = lambda hub, role: F.struct(hub.alias("hub"), F.lit(role).alias("role"))
    cut = lambda i: F.concat(F.substring(core, F.lit(1), i - 1), F.substring(core, i + 1, F.length(core)))
    each = F.when(F.length(core) >= X.FUZZY_LEAST, F.sequence(F.lit(1), F.length(core))).otherwise(F.array().cast("array<int>"))
    cuts = F.flatten(F.transform(each, lambda i: F.array(place(of(F.lit("S"), i.cast("string"), cut(i)), ALL), place(of(F.lit("D"), cut(i)), LONG))))
    whole = F.when(F.length(core) >= X.FUZZY_LEAST - 1, F.array(place(of(F.lit("D"), core), SHORT))).otherwise(F.array().cast("array<struct<hub:string,role:int>>"))
    return F.array_distinct(F.concat(F.array(place(of(F.lit("L"), letters), ALL)), cuts, whole))


def _met(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input: sorted, as their compressed files say little about their size in memory."""
    return left.join(right.hint("merge"), on, how)


def near(names: DataFrame) -> DataFrame:
    """hub, role and key of the hubs in which a name may have a neighbour."""
    rows = names.select("key", F.explode(hubs()).alias("h")).select("key", "h.hub", "h.role")
    n = lambda role: F.count(F.when(F.col("role") == role, 1))
    shared = rows.groupBy(F.col("hub").alias("h_")).agg(n(ALL).alias("a"), n(LONG).alias("l"), n(SHORT).alias("s")).filter("a > 1 or (l > 0 and s > 0)")
    return _met(rows, shared, F.col("hub") == F.col("h_")).select("hub", "role", "key")


def least(rows: DataFrame, which: Column, name: str) -> DataFrame:
    """By hub, the least key of each role for which `which` holds."""
    return rows.filter(which).groupBy(F.col("hub").alias("h_"), F.col("role").alias("r_")).agg(F.min("key").alias(name))


def beside(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """rows with the sums of the role that each has neighbours in."""
    other = reduce(lambda c, r: c.when(F.col("role") == r, OTHERS[r]), OTHERS, F).otherwise(None)
    return _met(rows, sums, (F.col("hub") == F.col("h_")) & (F.col("r_") == other), "left").drop("h_", "r_")


def settled(links: DataFrame, names: DataFrame) -> DataFrame:
    """key and status of all names, in rounds over links (hub, role, key)."""
    state = written(names.select("key", F.lit(OPEN).alias("status")), "merge-state")
    while not state.filter(F.col("status") == OPEN).isEmpty():
        known = state.filter(F.col("status") != OUT).select(F.col("key").alias("k_"), "status")
        rows = written(_met(links, known, F.col("key") == F.col("k_")).drop("k_"), "merge-links")
        open_ = F.col("status") == OPEN
        first = rows.groupBy(F.col("hub").alias("h_"), F.col("role").alias("r_")).agg(F.min(F.when(~open_, F.col("key"))).alias("taken"), F.min(F.when(open_, F.col("key"))).alias("first"))
        # Keys behind the first open one of a hub: the least of them is the second.
        later = _met(rows.filter(open_), first, (F.col("hub") == F.col("h_")) & (F.col("role") == F.col("r_"))).filter(F.col("key") > F.col("first"))
        second = later.groupBy(F.col("hub").alias("h2_"), F.col("role").alias("r2_")).agg(F.min("key").alias("second"))
        sums = _met(first, second, (F.col("h_") == F.col("h2_")) & (F.col("r_") == F.col("r2_")), "left").drop("h2_", "r2_")
        before = lambda c: F.when(F.col(c) < F.col("key"), F.col(c))
        seen = beside(rows.filter(open_), sums).groupBy("key").agg(
            F.max((F.col("taken") < F.col("key")).cast("int")).alias("out"), F.min(before("first")).alias("low"), F.max(before("first")).alias("high"), F.max((F.col("second") < F.col("key")).cast("int")).alias("more")
        )
        # What a key hangs on: null where its own status is known.
        out, alone = F.coalesce("out", F.lit(0)) == 1, F.col("low").isNull()
        status = F.when(out, OUT).when(alone, ACCEPTED).otherwise(OPEN)
        single = ~out & ~alone & (F.col("low") == F.col("high")) & (F.coalesce("more", F.lit(0)) == 0)
        left = _met(state.filter(open_).select("key"), seen.withColumnRenamed("key", "k_"), F.col("key") == F.col("k_"), "left")
        now = passed_on(written(left.select("key", status.alias("status"), F.when(single, F.col("low")).alias("on")), "merge-round"))
        new = now.select(F.col("key").alias("k_"), F.col("status").alias("s_"))
        state = written(_met(state, new, F.col("key") == F.col("k_"), "left").select("key", F.coalesce("s_", "status").alias("status")), "merge-state")
    return state


def passed_on(rows: DataFrame) -> DataFrame:
    """rows (key, status, on) with the status of those that hang, alternately, on a key whose status is known."""
    chain = rows.filter("on is not null").select("key", "on", F.lit(True).alias("flips"))
    if chain.isEmpty():
        return rows
    ends = rows.filter("on is null").select(F.col("key").alias("e_"), F.col("status").alias("end"))
    while True:
        step = chain.select(F.col("key").alias("k_"), F.col("on").alias("o_"), F.col("flips").alias("f_"))
        chain = written(_met(chain, step, F.col("on") == F.col("k_"), "left").select("key", F.coalesce("o_", "on").alias("on"), F.when(F.col("f_").isNull(), F.col("flips")).otherwise(F.col("flips") != F.col("f_")).alias("flips")), "merge-chain")
        if _met(chain, step, F.col("on") == F.col("k_"), "left_semi").isEmpty():
            break
    same = F.when(F.col("flips"), F.when(F.col("end") == ACCEPTED, OUT).otherwise(ACCEPTED)).otherwise(F.col("end"))
    found = _met(chain, ends, F.col("on") == F.col("e_")).filter(F.col("end") != OPEN).select(F.col("key").alias("c_"), same.alias("new"))
    return _met(rows, found, F.col("key") == F.col("c_"), "left").select("key", F.coalesce("new", "status").alias("status"))


def into(names: DataFrame, few: int = FEW) -> DataFrame:
    """category, normal, into: which name each name counts as.

    names: category, normal (both known), order (any type that sorts; a name's place within its category) and
    form (none: empty), core, letters. Up to `few` places in hubs, which are counted, are folded in one task.
    """
    spark, order = names.sparkSession, ["category", "order", "normal"]
    names = written(names, "merge-names")
    ranges = max(1, -(-names.count() // NAMES))
    # Parts are in order and their rows too, so that these ids are.
    names = written(names.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()), "merge-keys")
    places = names.agg(F.sum(2 * F.length("core") + 2)).first()[0] or 0  # at most
    with in_parts(spark, max(1, -(-places // PLACES))):
        links = written(near(names), "merge-hubs")
        if links.limit(few + 1).count() > few:
            return written(_in_rounds(names, links), "merge-into")
    linked = _met(names, links.select(F.col("key").alias("k_")), F.col("key") == F.col("k_"), "left_semi")
    rows = linked.coalesce(1).sortWithinPartitions("order", "normal").select("category", "form", "normal", "core", "letters")
    return rows.mapInPandas(_fold, "category string, normal string, into string").union(_alone(names, links))


def _alone(names: DataFrame, links: DataFrame) -> DataFrame:
    return _met(names, links.select(F.col("key").alias("k_")), F.col("key") == F.col("k_"), "left_anti").select("category", "normal", F.col("normal").alias("into"))


def _in_rounds(names: DataFrame, links: DataFrame) -> DataFrame:
    linked = written(_met(names, links.select(F.col("key").alias("k_")), F.col("key") == F.col("k_"), "left_semi"), "merge-linked")
    state = settled(links, linked)
    taken = _met(links, state.filter(F.col("status") == ACCEPTED).select(F.col("key").alias("k_")), F.col("key") == F.col("k_"), "left_semi")
    out = _met(links, state.filter(F.col("status") == OUT).select(F.col("key").alias("k_")), F.col("key") == F.col("k_"), "left_semi")
    best = beside(out, least(taken, F.lit(True), "head")).groupBy("key").agg(F.min("head").alias("head"))
    accepted = state.filter(F.col("status") == ACCEPTED).select("key", F.col("key").alias("head"))
    own, heads = linked.select(F.col("key").alias("k_"), "category", "normal"), linked.select(F.col("key").alias("h_"), F.col("normal").alias("into"))
    pairs = _met(best.unionByName(accepted), own, F.col("key") == F.col("k_"))
    return _met(pairs, heads, F.col("head") == F.col("h_")).select("category", "normal", "into").union(_alone(names, links))
