"""Sharding by a two-pass external shuffle.

Pass one scatters the records into memory-sized buckets by seeded hashes. Pass two puts each bucket in
random order by a Fisher-Yates shuffle and hands it on, or writes it.

Law ``key``: a record's shard is the one whose hash with the doc_id is highest, so that doc_id and shard
count alone decide, and one more shard takes rows only into itself.

Defined results: a null text counts as empty; rows with a null doc_id share one shard; repeated rows each
get their own slot; an empty table gives no rows; columns beside doc_id and text travel along under their
names, except those named like the result's columns, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from maskwerk.llm.common import documents, text_bytes

BUCKET_BYTES = 16 << 20
ROW_BYTES = 16


def key_shard(doc_id: Column, shards: int) -> Column:
    """The shard with the highest hash of (doc_id, shard); ties go to the lower one."""
    scores = F.array(*[F.xxhash64(doc_id, F.lit(s)) for s in range(shards)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _shuffler(seed: int, order: list[str]) -> Callable[[pa.Table], pa.Table]:
    def shuffle(table: pa.Table) -> pa.Table:
        # Rows arrive in any order; a fixed one first, so that a task that runs again gives the same slots.
        table = table.sort_by([(c, "ascending") for c in order])
        shard, bucket = table["shard"][0].as_py(), table["bucket"][0].as_py()
        rng = np.random.Generator(np.random.PCG64([seed, shard, bucket]))
        at = np.arange(table.num_rows)
        rng.shuffle(at)  # Fisher-Yates
        table = table.take(pa.array(at))
        return table.append_column("place", pa.array(np.arange(table.num_rows), pa.int64()))

    return shuffle


def shard(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard, in random order within shards.

    Buckets hold about bucket_bytes of text: each shard has as many as its mean size asks for. Slots run
    through the buckets of a shard, from counts by bucket that are summed before the shuffle.
    """
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "bucket", "place", "before", "s_", "b_")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = docs.drop(*made)
    sized = kept.withColumns({
        "size": text_bytes() + ROW_BYTES,
        "text_crc32": F.crc32(text.cast("binary")),
        "shard": key_shard(F.col("doc_id"), shards),
    })
    total = sized.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-int(total) // (shards * bucket_bytes)))
    scattered = sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    order = ["doc_id", "text_crc32", "size", *[f.name for f in kept.schema if f.name not in ("doc_id", "text") and isinstance(f.dataType, (T.StringType, T.NumericType))]]
    schema = T.StructType([*scattered.schema.fields, T.StructField("place", T.LongType())])
    counts = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("shard").alias("s_"), F.col("bucket").alias("b_"), before.alias("before"))
    placed = scattered.groupBy("shard", "bucket").applyInArrow(_shuffler(seed, order), schema)
    joined = placed.join(starts, (F.col("shard") == F.col("s_")) & (F.col("bucket") == F.col("b_")))
    return joined.withColumns({
        "slot": F.col("before") + F.col("place"),
        "law": F.lit("key"),
        "grown_shard": key_shard(F.col("doc_id"), shards + 1),
    }).drop("s_", "b_", "bucket", "place", "before")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder of Parquet files for each shard, rows in slot order."""
    out = shard(docs, **options)
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
