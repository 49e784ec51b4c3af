"""The pipeline's stages, each on what its predecessor kept, against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from maskwerk.llm import ngrams, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Prose, junk, near and exact copies, a shared passage, secrets, repeated rows, nulls."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("aeinorst", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.3 else word() for _ in range(n))
    passage = prose(40)
    rows = [(i, prose(rng.randint(60, 150)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(10)]
    rows += [(200 + i, rows[i][1] + " " + word(), "en", "s1") for i in range(10)]
    rows += [(300 + i, prose(50) + "\n" + passage + "\n" + prose(50), "en", "s2") for i in range(6)]
    rows += [(400, prose(60) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(20), "en", "s0"), (401, "NO!! " * 80, "en", "s0"), (402, "short", "en", "s0"), (403, None, None, None)]
    rows += [(404, prose(80), "en", "s1")] * 3
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    return where


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def similar(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


def test_stages(spark, corpus, tmp_path):
    docs, seen = spark.read.parquet(f"{corpus}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, corpus)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(rows_of(docs))
    start = rows_of(spark.read.parquet(f"{corpus}/documents.parquet"))
    judged = {(r["doc_id"], r["text"]) for r in quality.judged(spark.read.parquet(f"{corpus}/documents.parquet")).filter("kept").collect()}
    assert Counter(seen[0]) == Counter(r for r in start if (r[0], r[1]) in judged)
    assert {401, 402, 403}.isdisjoint(r[0] for r in seen[0]) and {r[0] for r in seen[0]} >= set(range(60))

    groups: list[list[tuple]] = []
    for r in sorted(seen[0]):
        linked = [g for g in groups if any(similar(r[1], x[1]) for x in g)]
        groups = [g for g in groups if g not in linked] + [[x for g in linked for x in g] + [r]]
    assert Counter(seen[1]) == Counter(min(g) for g in groups)

    first: dict[bytes, int] = {}
    for i, t, *_ in seen[1]:
        b = t.encode()
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(first.get(b[s : s + 50], i), i)
    want = []
    for i, t, lang, source, _ in seen[1]:
        b, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode()
        want.append((i, kept, lang, source, len(kept)))
    assert Counter(seen[2]) == Counter(want) and sum(len(r[1]) for r in seen[2]) < sum(len(r[1]) for r in seen[1])

    hidden = [(i, re.sub(r'token = "[0-9a-f]{40}', "[secret]", t), lang, s) for i, t, lang, s, _ in seen[2]]
    assert Counter(r[:4] for r in seen[3]) == Counter(hidden) and all(r[4] == len(r[1]) for r in seen[3])

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    total = sum(len(library.encode(r[1], add_special_tokens=False).ids) + 1 for r in seen[3])
    assert sum(r[3] for r in seen[4]) == total
    assert Counter(map(tuple, corpus_pipeline.run(spark, corpus).collect())) == Counter(seen[4])


@pytest.mark.parametrize("which", ["docs", "crowd", "none", "sample"])
def test_stages_take_any_table(spark, which, request, tmp_path):
    docs = request.getfixturevalue(which)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))


def test_one_representative_each(spark):
    rows = [(5, "a b c d e f", "x"), (3, "a b c d e f", "y"), (3, "a b c d e f", "y"), (None, "a b c d e f", "z"), (None, "q r s t u v", "z"), (7, None, "w"), (8, "", "w")]
    given = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert Counter(map(tuple, ngrams.representatives(given).collect())) == Counter([rows[1], rows[4], rows[5], rows[6]])
    assert given.filter(F.col("doc_id") > 100).count() == ngrams.representatives(given.filter(F.col("doc_id") > 100)).count() == 0
