"""Span algebra on array columns: union, overlap resolution, splicing, counting. No shuffle.

Work grows with the number of spans and its logarithm; spans that reach into each other in one unbroken chain are
folded one after the other, with copies that grow with the power of one and a half.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwerk.functions import arrays as A

SPAN = "struct<start:int,end:int,category:string,text:string,score:double,ord:int>"


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def as_spans(hits: Column, category: str, score: float, order: int) -> Column:
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit(category).alias("category"), h["text"].alias("text"), F.lit(float(score)).alias("score"), F.lit(order).alias("ord")))


def apart(low: Column, high: Column) -> Column:
    """Spans of low that overlap none of high.

    In order of start, a span is overlapped by one that begins no later and reaches beyond its start, or by
    one that begins behind it, the first of which begins before its end.
    """
    marked = lambda spans, n: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("low"), s.alias("span")))

    def free(both: Column) -> Column:
        reach = A.running(F.transform(both, lambda x: F.when(x["low"] == 0, x["span"]["end"])), F.greatest)
        next_ = F.reverse(A.running(F.reverse(F.transform(both, lambda x: F.when(x["low"] == 0, x["start"]))), F.least))
        ends = F.arrays_zip(both.alias("x"), reach.alias("reach"), next_.alias("next"))
        clear = lambda e: (e["x"]["low"] == 1) & (F.coalesce(e["reach"], F.lit(-1)) <= e["x"]["start"]) & (e["next"].isNull() | (e["next"] >= e["x"]["span"]["end"]))
        return F.transform(F.filter(ends, clear), lambda e: e["x"]["span"])

    return A.let(F.struct(low.alias("low"), high.alias("high")), lambda p: F.when((F.size(p["low"]) == 0) | (F.size(p["high"]) == 0), p["low"]).otherwise(A.let(F.array_sort(F.concat(marked(p["low"], 1), marked(p["high"], 0))), free)))


def _chain(spans: Column) -> Column:
    """Of spans in order that reach into each other, those that stay.

    A fold copies what it has gathered at each step, so it goes over parts, as many as each has spans.
    """
    start = lambda last: F.struct(none().alias("done"), last.alias("last"))

    def step(a: Column, x: Column) -> Column:
        last, new = a["last"], x["span"]
        size = lambda s: F.struct(s["end"] - s["start"], s["score"])
        keep = F.struct(a["done"].alias("done"), F.when(size(new) > size(last), new).otherwise(last).alias("last"))
        first = F.struct(a["done"].alias("done"), new.alias("last"))
        more = F.struct(F.concat(a["done"], F.array(last)).alias("done"), new.alias("last"))
        return F.when(last.isNull(), first).when(new["start"] < last["end"], keep).otherwise(more)

    def part(a: Column, some: Column) -> Column:
        return A.let(F.aggregate(some, start(a["last"]), step), lambda b: F.struct(F.concat(a["done"], b["done"]).alias("done"), b["last"].alias("last")))

    def parts(x: Column) -> Column:
        cut = lambda i: F.slice(x["all"], i * x["size"] + 1, x["size"])
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x["all"]) - 1) / x["size"]).cast("int")), cut)

    cuts = A.let(F.struct(spans.alias("all"), F.ceil(F.sqrt(F.size(spans))).cast("int").alias("size")), parts)
    return F.aggregate(cuts, start(F.lit(None).cast(SPAN)), part, lambda a: F.concat(a["done"], F.array(a["last"])))


def resolve(spans: Column) -> Column:
    """Non-overlapping spans.

    By start, longer first, higher score first, then recogniser order; a span that begins before the last
    one kept ends replaces it only if it is longer, or as long with a higher score. Where a span begins
    behind all ends before it, a new chain begins; chains are resolved each for itself.
    """
    key = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("short"), (-s["score"]).alias("low"), s["ord"].alias("ord"), s.alias("span")))

    def chains(x: Column) -> Column:
        size = lambda h, j: F.coalesce(F.get(x["heads"], j + 1), F.size(x["all"])) - h
        alone = lambda h: F.array(F.get(x["all"], h)["span"])
        return F.flatten(F.transform(x["heads"], lambda h, j: F.when(size(h, j) == 1, alone(h)).otherwise(_chain(F.slice(x["all"], h + 1, size(h, j))))))

    furthest = lambda ordered: A.running(F.transform(ordered, lambda k: k["span"]["end"]), F.greatest)
    begun = lambda ordered: A.let(furthest(ordered), lambda far: F.struct(ordered.alias("all"), A.heads(ordered, far).alias("heads")))
    return A.let(F.array_sort(key), lambda o: F.when(F.size(o) < 2, F.transform(o, lambda k: k["span"])).otherwise(A.let(begun(o), chains)))


def covered(spans: Column) -> Column:
    """The stretches (start, end) that spans, ordered by start, cover; those that only touch stay apart."""

    def stretches(x: Column) -> Column:
        last = lambda j: F.coalesce(F.get(x["heads"], j + 1), F.size(x["all"])) - 1
        return F.transform(x["heads"], lambda h, j: F.struct(F.get(x["all"], h)["start"].alias("start"), F.get(x["far"], last(j)).alias("end")))

    begun = lambda o, far: F.struct(o.alias("all"), far.alias("far"), A.heads(o, far).alias("heads"))
    return A.let(spans, lambda o: A.let(A.running(F.transform(o, lambda s: s["end"]), F.greatest), lambda far: A.let(begun(o, far), stretches)))


def splice(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """text with each of some non-overlapping sorted spans replaced by replacement(span)."""

    def joined(x: Column) -> Column:
        end = lambda i: F.coalesce(F.get(x["spans"], i)["end"], F.lit(0))
        parts = F.transform(x["spans"], lambda s, i: F.concat(A.between(x["parts"], end(i - 1), s["start"]), replacement(s)))
        return F.concat(F.array_join(parts, ""), A.between(x["parts"], end(F.size(x["spans"]) - 1), x["n"]))

    return A.let(F.struct(A.pieces(text).alias("parts"), F.length(text).alias("n"), spans.alias("spans")), joined)


def counts(spans: Column) -> Column:
    """map<string,int>: spans of each category."""
    by_name = lambda all_, names: F.map_from_arrays(names, F.transform(names, lambda c: F.size(F.filter(all_, lambda x: x == c))))
    return A.let(F.transform(spans, lambda s: s["category"]), lambda all_: A.let(F.array_distinct(all_), lambda names: by_name(all_, names)))


def distinct_ranges(spans: Column) -> Column:
    """The first span of each range, by start, then end."""
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"])
    return A.let(F.array_sort(spans), lambda o: F.filter(o, lambda s, i: (i == 0) | ~same(F.get(o, i - 1), s)))
