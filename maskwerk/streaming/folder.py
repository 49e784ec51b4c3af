"""Drop folders as streams: texts that come in are anonymised; what still looks personal is quarantined.

Fail closed: a text whose output has a residual hit of a gate category never reaches the output folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwerk.operators import mapping
from maskwerk.operators.recognizers import Recognizer, bundle, detect
from maskwerk.streaming.limits import allowed

__all__ = ["GATE", "allowed", "gated", "incoming", "residual", "watch"]

#: Categories precise enough that one hit in an output stops it.
GATE = ("IBAN", "BIC", "UID", "SVNR", "STEUERNR", "TAX_ID", "AHV", "CREDITCARD", "EMAIL", "SECRET")


def residual(text: Column, recognizers: Sequence[Recognizer] | None = None, categories: Sequence[str] = GATE) -> Column:
    """Hits of the gate's categories in an output."""
    some = [r for r in recognizers or bundle() if r.categories & set(categories)]
    return F.size(F.filter(detect(text, some), lambda s: s["category"].isin(*categories)))


def gated(results: DataFrame, column: str = "anonymized") -> DataFrame:
    """results with residual, passed and no_hits (nothing was found, which is worth a warning)."""
    return results.withColumn("residual", residual(F.col(column))).withColumns({"passed": F.col("residual") == 0, "no_hits": F.size("spans") == 0})


def incoming(spark: SparkSession, folder: str, pattern: str = "[!_]*.txt") -> DataFrame:
    """The stream of whole files of a folder; names with a leading underscore are skipped."""
    stream = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(folder)
    return stream.select(F.col("_metadata.file_path").alias("doc_id"), F.lit(0).cast("long").alias("seg_no"), F.col("value").alias("text"))


def watch(spark: SparkSession, folder: str, output: str, quarantine: str, store: mapping.Store, checkpoint: str, once: bool = True, seconds: int = 3) -> StreamingQuery:
    """Starts the stream. Each batch goes on from the stored mapping, commits the next one, then writes its texts.

    A batch that runs again after a failure finds its commit and only writes its texts.
    """

    def handle(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        out = store.update(lambda known: mapping.anonymize(batch, known), batch=f"{checkpoint}#{number}")
        done = gated(out).persist()
        try:
            done.filter("passed").select("doc_id", "anonymized", "no_hits").write.mode("overwrite").parquet(f"{output}/batch={number}")
            done.filter("not passed").select("doc_id", "residual").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        finally:
            done.unpersist()

    writer = incoming(spark, folder).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
