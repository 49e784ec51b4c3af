"""A model's answers, kept by content: what has been answered once is not asked again.

An answer belongs to a model's version and to a text without its white space, by digest. Answers are tables in a
folder, a new one for each run that asked something, which a commit names; a run that fails commits none. Of
texts that are equal but for white space one is asked, the least. Two runs at once may ask the same; the answer
of the earlier commit counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwerk.operators.commits import Commits, Conflict

VALUES = "array<struct<text:string,type:string>>"


def content_key(text: Column) -> Column:
    """Digest of a text without white space; a null text counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""), 256)


class Answers:
    """Answers of one model's version in a folder that driver and executors share."""

    ATTEMPTS = 50

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        self.commits = Commits(spark, f"{self.path}/_commits")

    def known(self) -> DataFrame:
        """key and values of this model's answers, one for each key."""
        if self.commits.latest() < 0:
            return self.spark.createDataFrame([], f"key string, values {VALUES}")
        entries = self.spark.read.option("pathGlobFilter", "[0-9]*.json").text(f"{self.path}/_commits")
        number = F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9]+)", 1).cast("long")
        told = entries.select(number.alias("number"), F.get_json_object("value", "$.data").alias("data"), F.get_json_object("value", "$.model").alias("model")).filter(F.col("model") == self.model)
        names = [(r["number"], r["data"]) for r in told.collect()]
        if not names:
            return self.spark.createDataFrame([], f"key string, values {VALUES}")
        order = self.spark.createDataFrame(names, "number long, data string")
        rows = self.spark.read.schema(f"key string, values {VALUES}").parquet(*[f"{self.path}/{n}" for _, n in names])
        rows = rows.withColumn("data_", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).join(F.broadcast(order), F.col("data_") == F.col("data"))
        return rows.groupBy("key").agg(F.min_by("values", "number").alias("values"))

    def answered(self, texts: DataFrame, ask: Callable[[pd.Series], pd.Series], column: str = "text") -> DataFrame:
        """texts with values: lists of {text, type}. ask gives them for texts, in batches on the executors."""
        keyed = texts.withColumn("key_", content_key(F.col(column)))
        absent = keyed.groupBy(F.col("key_").alias("key")).agg(F.coalesce(F.min(column), F.lit("")).alias("asked")).join(self.known().select("key"), "key", "left_anti")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"key": batch["key"], "values": ask(batch["asked"])})

        name = f"answers-{uuid.uuid4().hex}"
        absent.mapInPandas(run, f"key string, values {VALUES}").write.parquet(f"{self.path}/{name}")
        if not self.spark.read.schema("key string").parquet(f"{self.path}/{name}").isEmpty():
            for _ in range(self.ATTEMPTS):
                if self.commits.put(self.commits.latest() + 1, {"data": name, "model": self.model}):
                    break
            else:
                raise Conflict(self.path)
        return keyed.join(self.known().select(F.col("key").alias("k_"), "values"), F.col("key_") == F.col("k_"), "left").drop("key_", "k_")
