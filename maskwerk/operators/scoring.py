"""Detection quality: span matching, precision and recall, leaks, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwerk.functions import patterns
from maskwerk.functions.text import canonical

THRESHOLD = 0.5


def overlap_share(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union of two intervals."""
    both = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return both / ((a_end - a_start) + (b_end - b_start) - both)


def _greedy(pairs: Column) -> Column:
    """How many expected spans get a partner: each, in order, takes the free found span of highest share; of equal ones the later.

    pairs: array of (e, choices), choices an array of (share, f).
    """
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        best = F.array_max(F.filter(x["choices"], lambda c: ~F.array_contains(a["taken"], c["f"])))
        return F.when(best.isNull(), a).otherwise(F.struct(F.concat(a["taken"], F.array(best["f"])).alias("taken"), (a["n"] + 1).alias("n")))

    return F.aggregate(F.array_sort(pairs), start, step, lambda a: a["n"])


def candidates(expected: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, category, e, f, share, from and to (what both cover) of pairs with a share of THRESHOLD or more, a half at least.

    expected has e, found has f beside doc_id, category, start, end. Two such spans differ in length by a factor
    of two at most, and in start by half of the longer: so an expected span goes to one cell, by the power of two
    in its length and its start in such steps, a found one to the few cells that a partner may be in.
    """
    if THRESHOLD < 0.5:
        raise ValueError("cells hold partners of a half or more")
    size = lambda k: F.floor(F.log2(F.col("end") - F.col("start")) + 1e-9).cast("int") + k
    long = lambda d: d.filter(F.col("end") > F.col("start"))
    cell = lambda place, k: F.floor(place / F.pow(F.lit(2.0), k)).cast("long")
    a = long(expected).withColumns({"k": size(0), "c": cell(F.col("start"), size(0))}).alias("a")

    def cells(k: int) -> Column:
        reach = F.greatest(F.pow(F.lit(2.0), size(k) + 1), F.col("end") - F.col("start")) / 2
        return F.transform(F.sequence(cell(F.col("start") - reach, size(k)), cell(F.col("start") + reach, size(k))), lambda c: F.struct(size(k).alias("k"), c.alias("c")))

    b = long(found).withColumn("h", F.explode(F.concat(*[cells(k) for k in (-1, 0, 1)]))).alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.category") == F.col("b.category")) & (F.col("a.k") == F.col("b.h.k")) & (F.col("a.c") == F.col("b.h.c"))
    share = overlap_share(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    ends = F.least("a.start", "b.start").alias("from"), F.greatest("a.end", "b.end").alias("to")
    return a.join(b, same).select(F.col("a.doc_id").alias("doc_id"), F.col("a.category").alias("category"), "e", "f", share.alias("share"), *ends).filter(F.col("share") >= THRESHOLD)


def matched(expected: DataFrame, found: DataFrame) -> DataFrame:
    """tp, fp and fn by document and category. Both: doc_id, category, start, end.

    Candidates meet by cells, and a sweep over what pairs cover parts them into stretches: those that share a span
    lie in one, so that the greedy choice is a fold over each stretch, of a few spans, and not over a document.
    """
    group = ["doc_id", "category"]
    rank = lambda d, n: d.select("doc_id", "category", "start", "end").withColumn(n, F.row_number().over(Window.partitionBy(*group).orderBy("start", "end")))
    e, f = rank(expected, "e"), rank(found, "f")
    sizes = e.groupBy(*group).agg(F.count("*").alias("n_expected")).join(f.groupBy(*group).agg(F.count("*").alias("n_found")), group, "full")
    sizes = sizes.na.fill(0, ["n_expected", "n_found"])
    order = Window.partitionBy(*group).orderBy("from", "to", "e", "f")
    pairs = candidates(e, f).withColumn("reach", F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.col("reach").isNull() | (F.col("from") >= F.col("reach"))
    pairs = pairs.withColumn("stretch", F.sum(begins.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    by_expected = pairs.groupBy(*group, "stretch", "e").agg(F.collect_list(F.struct("share", "f")).alias("choices"))
    hits = by_expected.groupBy(*group, "stretch").agg(_greedy(F.collect_list(F.struct("e", "choices"))).alias("tp")).groupBy(*group).agg(F.sum("tp").alias("tp"))
    out = sizes.join(hits, group, "left").withColumn("tp", F.coalesce("tp", F.lit(0).cast("long")))
    return out.select("doc_id", "category", "tp", (F.col("n_found") - F.col("tp")).alias("fp"), (F.col("n_expected") - F.col("tp")).alias("fn"))


def ratios(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn) with precision, recall and f1; an empty denominator counts as 1, f1 of two zeros as 0."""
    share = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a / b)
    out = counts.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / both))


def report(by_document: DataFrame) -> DataFrame:
    """Ratios by category, and in total (category null), rounded to four digits."""
    sums = by_document.rollup("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return ratios(sums.na.fill(0)).withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


def detailed_report(by_document: DataFrame) -> DataFrame:
    """Ratios by fixture (doc_id), by category, and in total: level says which; names of the other levels are null."""
    sums = by_document.groupingSets([["doc_id"], ["category"], []], "doc_id", "category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.grouping_id().alias("_level"))
    level = F.element_at(F.create_map(F.lit(1), F.lit("fixture"), F.lit(2), F.lit("category"), F.lit(3), F.lit("total")), F.col("_level").cast("int"))
    return ratios(sums.na.fill(0, ["tp", "fp", "fn"])).select(level.alias("level"), "doc_id", "category", "tp", "fp", "fn", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


def as_markdown(rows: DataFrame, most: int = 1000) -> str:
    """A table for people, `most` rows at most."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(rows.columns), "|" + "-|" * len(rows.columns), *map(line, found)])


def negative_control(originals: DataFrame, secrets: DataFrame, column: str = "text") -> DataFrame:
    """One row: secrets, seen and ok. A leak check that works sees every secret in its original text."""
    seen = leaks(originals, secrets, column).distinct().count()
    wanted = secrets.select("doc_id", "category", "value").filter(canonical(F.col("category"), F.col("value")) != "").distinct().count()
    return secrets.sparkSession.createDataFrame([(wanted, seen, wanted == seen)], "secrets long, seen long, ok boolean")


def check_bundle(checks: DataFrame) -> DataFrame:
    """One row of totals over checks (name, status): passed, failed, skipped, and ok, which is that none failed and one passed."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    return checks.agg(of("pass").alias("passed"), of("fail").alias("failed"), of("skip").alias("skipped")).withColumn("ok", (F.col("failed") == 0) & (F.col("passed") > 0))


def leaks(documents: DataFrame, secrets: DataFrame, column: str = "anonymized") -> DataFrame:
    """doc_id, category, value of each secret whose canonical form is still in its document's canonical text."""
    rows = secrets.join(documents.select("doc_id", F.col(column).alias("_text")), "doc_id")
    needle = canonical(F.col("category"), F.col("value"))
    return rows.filter((needle != "") & canonical(F.col("category"), F.col("_text")).contains(needle)).select("doc_id", "category", "value")


def leak_rates(secrets: DataFrame, leaked: DataFrame, *by: str) -> DataFrame:
    """Secrets, leaks and their rate by the given columns and in total."""
    marked = secrets.join(leaked.select("doc_id", "category", "value").distinct().withColumn("_leak", F.lit(1)), ["doc_id", "category", "value"], "left")
    sums = marked.rollup(*by).agg(F.count("*").alias("secrets"), F.sum(F.coalesce("_leak", F.lit(0))).alias("leaks"))
    return sums.withColumn("rate", F.col("leaks") / F.col("secrets"))


def false_positive_rate(counts: DataFrame) -> DataFrame:
    """fp / (tp + fp) by category; null without findings."""
    return counts.groupBy("category").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")).select("category", F.try_divide(F.col("fp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")).alias("fp_rate"))


def gap_list(thresholds: DataFrame, scores: DataFrame, false_positives: DataFrame | None = None, most_fp: float = 0.02) -> DataFrame:
    """All gaps, the worst first: severity, title, category, measured, wanted.

    Gaps of gate_gaps, and categories whose rate of false positives (category, fp_rate) is over most_fp.
    """
    f1 = gate_gaps(thresholds, scores)
    told = F.when(F.col("f1").isNull(), F.concat(F.lit("F1 of "), "category", F.lit(" is not measured"))).otherwise(F.concat(F.lit("F1 of "), "category", F.lit(" is too low")))
    out = f1.select("severity", told.alias("title"), "category", F.col("f1").alias("measured"), F.col("least").alias("wanted"))
    if false_positives is not None:
        over = false_positives.filter(F.col("fp_rate") > most_fp)
        out = out.unionByName(over.select(F.lit(1).alias("severity"), F.concat(F.lit("False positives of "), "category", F.lit(" are too many")).alias("title"), "category", F.col("fp_rate").alias("measured"), F.lit(most_fp).alias("wanted")))
    return out.orderBy("severity", "title")


def gate_gaps(thresholds: DataFrame, scores: DataFrame) -> DataFrame:
    """Categories whose f1 misses its threshold or is not measured, the worst first.

    thresholds: category, least. scores: category, f1. Severity 0: not measured; 1: more than 0.1 below; 2: below.
    """
    rows = thresholds.join(scores.select("category", "f1"), "category", "left")
    severity = F.when(F.col("f1").isNull(), 0).when(F.col("f1") < F.col("least") - 0.1, 1).when(F.col("f1") < F.col("least"), 2)
    return rows.withColumn("severity", severity).filter("severity is not null").orderBy("severity", "category")


#: Names of a gate's table that stand for categories of ours.
ALIASES = {"ORG": "COMPANY", "BIRTHDATE": "DATE", "STEUER_ID": "TAX_ID", "UST_ID": "UID"}


def gate_rows(lines: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """category and least from Markdown table rows '| CATEGORY | >= 0.95 |' (lines: n, value); the first row of a category counts.

    A category that aliases names goes by what it stands for.
    """
    pattern = r"^\|\s*\**([A-Z_]+)\**\s*\|[^0-9|]*([01](?:[.,][0-9]+)?)[^|]*\|"
    rows = lines.select("n", F.regexp_extract("value", pattern, 1).alias("category"), F.regexp_replace(F.regexp_extract("value", pattern, 2), ",", ".").alias("least")).filter("category != ''")
    for name, stands_for in (ALIASES if aliases is None else aliases).items():
        rows = rows.withColumn("category", F.when(F.col("category") == name, F.lit(stands_for)).otherwise(F.col("category")))
    return rows.groupBy("category").agg(F.min_by("least", "n").cast("double").alias("least"))


def coverage(keywords: DataFrame, files: DataFrame, block: int = 100_000) -> DataFrame:
    """keyword and n_files: how many files (path, text) hold each keyword, in any case. Keywords are distinct.

    Texts are read once for each `block` keywords, which the driver holds and one automaton finds. An empty keyword is in none.
    """
    low = keywords.select(F.lower("keyword").alias("keyword")).filter("keyword != ''").distinct()
    blocks = -(-low.count() // block)
    hits = files.select("path", F.lit("").alias("k_")).filter("k_ != ''")
    for n in range(blocks):
        words = [r["keyword"] for r in low.filter(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == n).collect()]
        hits = hits.unionByName(files.select("path", F.explode(patterns.held_by(words)(F.lower("text"))).alias("k_")))
    counts = hits.groupBy("k_").agg(F.countDistinct("path").alias("n_files"))
    return keywords.join(counts, F.lower("keyword") == F.col("k_"), "left").drop("k_").na.fill(0, ["n_files"])
