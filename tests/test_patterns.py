"""Many patterns in one pass against single scans."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from maskwerk.functions import patterns as P
from maskwerk.operators import recognizers, scoring

WORDS = ["Netz", "NETZWERK", "werk", "ß", "ss", "äÖ", "aa", "aaa", "a a", "x.y", "ſs", "K", "İx", "ᾳ", "q(", "  netz ", "z", ""]
TEXTS = ["netzwerk Netz netzwerkwerk", "aaaaa aa a aaaa", "ÄöÄÖ straße SS ſſ ſS", "K k K İX ix ᾼ ᾳ", "X.Y xzy x.y q( Q((", "", None, "🙂netz🙂aaa"]


def spans(spark, texts, recognizer):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = df.select("i", F.explode(recognizers.detect(F.col("text"), [recognizer], resolved=False)).alias("s")).select("i", "s.*").collect()
    return sorted((r["i"], r["start"], r["end"], r["text"]) for r in got)


def test_equal_to_single_scans(spark):
    """The automaton finds what a pattern of its own for each term finds, each place once."""
    one = {x for w in WORDS for x in spans(spark, TEXTS, recognizers.terms([w], few=99))}
    assert set(spans(spark, TEXTS, recognizers.terms(WORDS, few=0))) == one and len(one) > 20


def test_random_terms(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abAB ") for _ in range(n))
    words, texts = [w for _ in range(40) if len((w := word(rng.randrange(2, 5))).strip()) > 1], [word(rng.randrange(60)) for _ in range(40)]
    want = {(i, m.start(), m.end(), m[0]) for w in words for i, t in enumerate(texts) for m in re.finditer(re.escape(w.strip()), t, re.I)}
    assert set(spans(spark, texts, recognizers.terms(words, few=0))) == want


def test_patterns_in_parts():
    assert [*P.parts(["aa", "b", "cccc", "d"], 3)] == [["aa", "b"], ["cccc"], ["d"]] and [*P.parts([])] == []


@pytest.mark.parametrize("most", [P.MOST_BYTES, 5])
def test_parts_find_the_same(spark, most):
    df = spark.createDataFrame([("netzwerk und mehr",)], "t string")
    (row,) = df.select(P.occurrences(["netz", "WERK", "und mehr", "zw"], most)("t").alias("h")).collect()
    assert [h["text"] for h in row["h"]] == ["netz", "zw", "werk", "und mehr"]


def test_a_hundred_thousand_terms(spark):
    """Time follows the text and what is found, and each hit is one that a search for its term finds."""
    rng = random.Random(1)
    words = list({"".join(rng.choice("abcdefghij") for _ in range(rng.randrange(6, 14))) for _ in range(100_000)})
    text = "".join(rng.choice("abcdefghij") for _ in range(60_000)) + " ".join(rng.sample(words, 500))
    want = {(m.start(), w) for w in words if w in text for m in re.finditer(w, text)}
    (row,) = spark.createDataFrame([(text,)], "t string").select(P.occurrences(words)("t").alias("h")).collect()
    assert {(h["start"], h["text"]) for h in row["h"]} == want and len(want) > 500
    automaton = P._automaton("words", words)
    took = []
    for n in (1, 8):
        start = time.process_time()
        P.found(text * n, automaton, words)
        took.append(time.process_time() - start)
    assert took[1] < 30 * took[0] + 0.5


def test_coverage_in_blocks(spark):
    words = spark.createDataFrame([(w,) for w in ("Netz", "werk", "nichts", "ÄÖ", "a", None, "")], "keyword string")
    files = spark.createDataFrame([("1", "netzwerk äö"), ("1", "Netz"), ("2", "WERKNETZ A"), ("3", None)], "path string, text string")
    for block in (1, 2, 100):
        got = {r["keyword"]: r["n_files"] for r in scoring.coverage(words, files, block).collect()}
        assert got == {"Netz": 2, "werk": 2, "nichts": 0, "ÄÖ": 1, "a": 1, None: 0, "": 0}
