"""Shared pieces of the training-data operators."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwerk.plans.tables import checkpointed, shared_dir, written

__all__ = ["BLOCK_BYTES", "Known", "Resting", "WHITE", "checkpointed", "documents", "shared_dir", "text_bytes", "written"]

#: Words of the contracts: runs without ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"
#: UTF-8 bytes of text that one block of documents holds on average.
BLOCK_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


class Known(dict):
    """A table in which a missing key gives itself and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.missed: dict[str, None] = {}

    def __missing__(self, key: str) -> str:
        self.missed[key] = None
        return key

    def renewed(self, most: int) -> Known:
        """This table, or once it has over `most` entries, an empty one."""
        return self if len(self) <= most else Known()


class Resting:
    """What a Python worker keeps from batch to batch, and forgets when it has been idle for a while.

    Workers outlive their stage; without that their tables would take the executor's memory from later ones.
    """

    IDLE_S = 2.0

    def __init__(self) -> None:
        self.known = Known()
        self._lock, self._timer, self._awake = threading.Lock(), None, False

    @contextmanager
    def awake(self) -> Iterator[None]:
        """While this lasts, nothing is forgotten."""
        with self._lock:
            self._awake = True
            if self._timer:
                self._timer.cancel()
        try:
            yield
        finally:
            with self._lock:
                self._awake = False
                self._timer = threading.Timer(self.IDLE_S, self._forget)
                self._timer.daemon = True
                self._timer.start()

    def _forget(self) -> None:
        with self._lock:
            if not self._awake:
                self.known = Known()
