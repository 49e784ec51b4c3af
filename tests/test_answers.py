"""A model's answers are kept by content, and asked for once."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwerk.operators.answers import Answers
from maskwerk.operators.recognizers import listed_values


def model(log):
    def ask(texts: pd.Series) -> pd.Series:
        with open(log, "a") as f:
            f.write("".join(f"{t!r}\n" for t in texts))
        return texts.map(lambda t: [{"text": w, "type": "PERSON"} for w in t.split() if w[:1].isupper()])

    return ask


def told(log):
    return sorted(log.read_text().splitlines()) if log.exists() else []


def test_asked_once(spark, tmp_path):
    log, docs = tmp_path / "log", spark.createDataFrame([(1, "Anna ruft Bert"), (2, "Anna  ruft\nBert"), (3, None), (4, ""), (5, "niemand")], "i int, text string")
    store = Answers(spark, str(tmp_path / "a"), "m1")
    first = {r["i"]: [v["text"] for v in r["values"]] for r in store.answered(docs, model(log)).collect()}
    assert first == {1: ["Anna", "Bert"], 2: ["Anna", "Bert"], 3: [], 4: [], 5: []} and len(told(log)) == 3
    more = docs.union(spark.createDataFrame([(6, "Neu hier")], docs.schema))
    assert {r["i"]: len(r["values"]) for r in store.answered(more, model(log)).collect()} == {1: 2, 2: 2, 3: 0, 4: 0, 5: 0, 6: 1}
    assert len(told(log)) == 4 and told(log)[-1] == "'niemand'" and store.commits.latest() == 1
    store.answered(more, model(log))
    assert len(told(log)) == 4 and store.commits.latest() == 1
    Answers(spark, str(tmp_path / "a"), "m2").answered(docs, model(log))
    assert len(told(log)) == 7


def test_a_failed_run_stores_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "i int, text string").repartition(4)
    store = Answers(spark, str(tmp_path / "a"), "m")

    def broken(texts):
        if any("7" in t for t in texts):
            raise RuntimeError("no answer")
        return texts.map(lambda t: [])

    with pytest.raises(Exception, match="no answer"):
        store.answered(docs, broken)
    assert store.known().count() == 0 and store.commits.latest() == -1


def test_answers_become_spans(spark, tmp_path):
    docs = spark.createDataFrame([("Anna ruft Bert, Annabell nicht. Anna!",)], "text string")
    out = Answers(spark, str(tmp_path / "a"), "m").answered(docs, model(tmp_path / "log"))
    (row,) = out.select(listed_values(F.col("values"), F.col("text"), 0).alias("s")).collect()
    assert sorted((s["start"], s["text"]) for s in row["s"] if s["text"] == "Anna") == [(0, "Anna"), (32, "Anna")]
