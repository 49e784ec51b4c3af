"""Quality rules: base counts, and the divergence of a document from its language.

A document's histograms of character classes and of common words are held against those of all documents
of its language by Jensen-Shannon distance (base 2, 0 to 1). Documents with few words have histograms
that scatter, so that the verdict asks for a minimum length, and allows the common words a distance that
falls with it: the one that words drawn from the language's own histogram exceed once in 1 / FALSE_ALARMS
documents, and SLACK. op8_quality_rules has a closed form of that, which SQL can state. All is
DataFrame expressions; the references are a row for each known language.

Defined results: a null text has no words and fails by its length; documents of unknown or null language
get no verdict by divergence; repeated rows and null ids are kept apart; an empty table gives no rows.
Columns beside text and lang travel along, except those named like the result's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwerk.llm.common import WHITE, documents, written

# Frequent function words of each language.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "las", "un", "por"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
# Character classes, as Java patterns. White space and the rest, mostly small letters, are two more.
CLASSES = {"upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "symbol": r"[#*$%&|<>]+", "mark": r"""[.,;:!?'"()\[\]{}/=_+@\\-]+"""}
#: What classes other than the last two are looked for in the rest of.
PLAIN = r"[a-z\x20\n]+"

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Words from which on a document is held against its language.
GUARD_WORDS = 50
#: Distances allowed: of classes, and of common words, the latter plus NOISE / sqrt(words). NOISE is sqrt(x / (8 ln 2)) with
#: the x that a chi-squared value of 12 degrees exceeds once in a thousand; MOST_COMMON keeps all good documents of one half of the labels.
MOST_CLASSES, MOST_COMMON, NOISE = 0.28, 0.02, 2.44
#: The allowance by noise: share of drawn documents beyond it, and what is added as real words are not drawn one by one.
FALSE_ALARMS, SLACK = 0.001, 0.01
#: Where noise is found by drawing: numbers of words GUARD_WORDS * STEP**k, so many of them, and draws at each.
STEP, STEPS, DRAWS = 1.25, 28, 20_000


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _sum(counts: str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def _counted(docs: DataFrame) -> DataFrame:
    """docs with _text, _words, _n, _classes and _common (counts; null for unknown languages)."""
    common = F.create_map(*[x for lang, words in COMMON.items() for x in (F.lit(lang), F.array(*map(F.lit, words)))])
    # `lang` may be absent from other tables; then no language is known.
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    out = docs.withColumns({"_text": F.coalesce(F.col("text").cast("string"), F.lit("")), "_lang": F.when(lang.isin(*COMMON), lang)})
    out = out.withColumns({"_words": F.array_remove(F.split("_text", WHITE), ""), "_list": common[F.col("_lang")], "_chars": F.length("_text")})
    out = out.withColumns({"_n": F.size("_words"), "_letters": F.length(F.array_join("_words", "")), "_odd": F.regexp_replace("_text", PLAIN, "")})
    own = [_without(F.col("_odd"), p) for p in CLASSES.values()]
    out = out.withColumn("_classes", F.array(*[c.cast("long") for c in own], (F.col("_chars") - F.col("_letters")).cast("long")))
    out = out.withColumn("_classes", F.concat("_classes", F.array(F.col("_chars") - _sum("_classes"))))
    # A lambda, not a column for each word: unrolled, the loops make a method that the JVM does not compile.
    out = out.withColumn("_common", F.transform("_list", lambda w: (F.col("_n") - F.size(F.array_remove(F.col("_words"), w))).cast("long")))
    return out.withColumn("_common", F.concat("_common", F.array(F.col("_n") - _sum("_common"))))


def references(counted: DataFrame) -> DataFrame:
    """_ref, ref_classes, ref_common: shares over all documents of each known language; at most a row for each."""
    n = len(CLASSES) + 2
    sums = counted.filter("_lang is not null").groupBy("_lang").agg(
        *[F.sum(F.col("_classes")[i]).alias(f"c{i}") for i in range(n)],
        *[F.sum(F.col("_common")[i]).alias(f"w{i}") for i in range(13)],
    )

    def shares(letter: str, n: int) -> Column:
        total = sum((F.col(f"{letter}{i}") for i in range(n)), F.lit(0))
        return F.array(*[F.col(f"{letter}{i}") / F.greatest(total, F.lit(1)) for i in range(n)])

    return sums.select(F.col("_lang").alias("_ref"), shares("c", n).alias("ref_classes"), shares("w", 13).alias("ref_common"))


def distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts from shares that sum to 1; null without counts."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(counts, shares, lambda c, q: part(c / total, (c / total + q) / 2) + part(q, (c / total + q) / 2))
    sum_ = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when((total > 0) & shares.isNotNull(), F.sqrt(F.greatest(sum_ / 2, F.lit(0.0))))


def noise(shares: list[float]) -> list[float] | None:
    """Distances from shares times sqrt(words) that FALSE_ALARMS of the draws exceed, at each number of words; None without shares."""
    q, rng, out = np.array(shares, float), np.random.default_rng(0), []
    if not q.sum():
        return None
    q /= q.sum()
    for k in range(STEPS):
        n = round(GUARD_WORDS * STEP**k)
        p = rng.multinomial(n, q, DRAWS) / n
        m = (p + q) / 2
        bits = [np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(1) for x in (p, np.broadcast_to(q, p.shape))]
        out.append(float(np.quantile(np.sqrt(np.maximum(sum(bits) / 2, 0)), 1 - FALSE_ALARMS) * n**0.5))
    return out


def allowed(words: Column, noises: Column) -> Column:
    """The distance of common words allowed at a number of words, between those of noises in proportion to the logarithm."""
    place = F.least(F.log(F.greatest(words, F.lit(GUARD_WORDS)) / GUARD_WORDS) / float(np.log(STEP)), F.lit(STEPS - 1.0))
    k = F.least(F.floor(place), F.lit(STEPS - 2)).cast("int")
    return SLACK + (F.get(noises, k) + (F.get(noises, k + 1) - F.get(noises, k)) * (place - k)) / F.sqrt(words)


def base_rules(counted: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    word = F.transform("_words", lambda w: F.xxhash64(w))
    out = counted.withColumns({"_hashes": word, "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    window = F.transform(F.sequence(F.lit(0), F.col("_n") - WINDOW), lambda i: F.xxhash64(*[F.col("_hashes")[i + k] for k in range(WINDOW)]))
    out = out.withColumn("_windows", F.when(F.col("_n") >= WINDOW, window))
    found = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_found", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), found))
    pairs, last = F.col("_found"), F.size("_found") - 1
    twice = F.filter("_found", lambda x, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(pairs, k + 1)["h"] == x["h"])))
    out = out.withColumn("_at", F.when(pairs.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("_at", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]
    out = out.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.col("_letters").cast("long"),
        "n_symbols": F.col("_classes")[list(CLASSES).index("symbol")],
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    })
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def judged(docs: DataFrame, keep_text: bool = True, by_noise: bool = True) -> DataFrame:
    """docs with the base rules' columns, class_distance, word_distance and kept; without text unless keep_text.

    What is counted in the texts is written, without them, and the references are made from that. Verdicts
    come from the same table, or, where texts have to go with them, from a second reading: a table with texts
    would need the disk of one more copy. The references have a row for each language of COMMON at most, so
    that they may be broadcast. Common words are allowed the distance of noise, or else its closed form.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")
    given = [c for c in docs.columns if c not in made and (keep_text or c != "text")]
    counts = _counted(docs.drop(*made))
    if keep_text:
        refs = references(written(counts.select("_lang", "_classes", "_common"), "counted"))
        counted = base_rules(counts).select(*given, *made[:6], "_lang", "_classes", "_common")
    else:
        counted = written(base_rules(counts).select(*given, *made[:6], "_lang", "_classes", "_common"), "counted")
        refs = references(counted)
    allowance = MOST_COMMON + NOISE / F.sqrt(F.col("n_words"))
    if by_noise:
        rows = [(r["_ref"], r["ref_classes"], r["ref_common"], noise(r["ref_common"])) for r in refs.collect()]
        refs = docs.sparkSession.createDataFrame(rows, "_ref string, ref_classes array<double>, ref_common array<double>, _noises array<double>")
        allowance = allowed(F.col("n_words"), F.col("_noises"))
    out = counted.join(F.broadcast(refs), F.col("_lang") == F.col("_ref"), "left")
    out = out.withColumns({"class_distance": distance(F.col("_classes"), F.col("ref_classes")), "word_distance": distance(F.col("_common"), F.col("ref_common"))})
    far = (F.col("class_distance") > MOST_CLASSES) | (F.col("word_distance") > allowance)
    kept = ~F.col("base_failed") & ~F.coalesce((F.col("n_words") >= GUARD_WORDS) & far, F.lit(False))
    # Always true, but no function of the row: so a filter on kept stays above what it is made from, which
    # would otherwise be put into the filter whole and evaluated again for each use.
    return out.withColumn("kept", kept & (F.monotonically_increasing_id() >= 0)).select(*given, *made)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir).select("doc_id", "text", "lang"), keep_text=False, by_noise=False).drop("lang", "class_distance", "word_distance")
