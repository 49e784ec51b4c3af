"""Tables that a plan writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session may do without: then a temporary one is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="maskwerk-")
        sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def dealt(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows in parts of about `size` rows, by a key: for narrow rows from which much work is made, as a small file is one task's input."""
    return rows.repartition(max(1, -(-rows.count() // size)), key)


@contextmanager
def in_parts(spark: SparkSession, n: int, file_bytes: str = "16m") -> Iterator[None]:
    """What is evaluated inside is shuffled into n parts, whatever their bytes are, and reads files in small ones: for rows that compress well."""
    some = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": file_bytes}
    before = {k: spark.conf.get(k, None) for k in some}
    try:
        for k, v in some.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: evaluated once, columnar and compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
