"""Profiles: a folder each, with key data, metadata, mapping versions and audit log.

The metadata of a profile is a few pairs, read and written by the driver; mapping and log are tables.
"""

from __future__ import annotations

import base64
import json
import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwerk.functions import text as X
from maskwerk.functions.keys import ITERATIONS, Keys, new_salt
from maskwerk.operators import audit, mapping, recognizers

NAME = re.compile(r"[A-Za-z0-9_ÄÖÜäöüß .&-]{1,64}")
VERSION = "1.0.0"


class WrongPassword(ValueError):
    pass


class Profile:
    """One client's mapping, log and settings."""

    def __init__(self, spark: SparkSession, root: str, name: str, password: str, iterations: int = ITERATIONS):
        if not NAME.fullmatch(name) or not name.strip():
            raise ValueError(f"not a profile name: {name!r}")
        self.spark, self.name = spark, name
        self.path = f"{root.rstrip('/')}/{re.sub(r'[^A-Za-z0-9]+', '_', name)}"
        meta = self.metadata()
        salt = base64.b64decode(meta["salt"]) if "salt" in meta else new_salt()
        self.keys = Keys.from_password(password, salt, int(meta.get("iterations", iterations)))
        if not meta:
            self._write_metadata({"name": name, "salt": base64.b64encode(salt).decode(), "iterations": str(iterations), "token": self.keys.token(), "schema_version": "1", "created": datetime.now(UTC).isoformat(timespec="seconds")})
        elif not self.keys.opens(meta["token"]):
            raise WrongPassword(name)
        self.store = mapping.Store(spark, f"{self.path}/mapping", self.keys.cipher, self.keys.digest)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def metadata(self) -> dict[str, str]:
        fs, p = self._fs(f"{self.path}/metadata")
        return json.loads(self.spark.read.text(f"{self.path}/metadata").first()[0]) if fs.exists(p) else {}

    def _write_metadata(self, pairs: dict[str, str]) -> None:
        self.spark.createDataFrame([(json.dumps(pairs, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/metadata")

    def set(self, key: str, value: str | None) -> None:
        """Sets a pair, or removes it."""
        pairs = self.metadata() | {key: value}
        self._write_metadata({k: v for k, v in pairs.items() if v is not None})

    def recognizers(self) -> list[recognizers.Recognizer]:
        meta = self.metadata()
        return recognizers.bundle(custom=json.loads(meta.get("terms", "[]")), user_regex=meta.get("pattern"))

    def log(self) -> DataFrame | None:
        fs, p = self._fs(f"{self.path}/audit")
        return self.spark.read.schema(audit.LOG).parquet(f"{self.path}/audit") if fs.exists(p) else None

    def _append(self, operation: str, texts: DataFrame, column: str) -> None:
        rows = texts.select(
            F.struct("doc_id", "seg_no").alias("seq"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp_utc"), F.lit(operation).alias("operation"),
            X.counts_json(F.col("entity_counts")).alias("entity_counts_json"), F.sha2(F.coalesce(F.col(column), F.lit("")), 256).alias("anonymized_text_sha256"),
            F.lit("n/a").alias("model_version"), F.lit(VERSION).alias("recognizer_version"),
        )
        log = self.log()
        audit.append(rows, log).write.mode("append").parquet(f"{self.path}/audit")

    def anonymize(self, segments: DataFrame) -> DataFrame:
        """segments with anonymized, spans and entity_counts; the mapping and the log go on."""
        known = self.recognizers()
        out = self.store.update(lambda table: mapping.anonymize(segments, table, known))
        self._append("anonymize", out, "anonymized")
        return out

    def deanonymize(self, segments: DataFrame, column: str = "text") -> DataFrame:
        known = self.store.load()
        if known is None:
            known = self.spark.createDataFrame([], mapping.MAPPING)
        out = mapping.deanonymize(segments, known, column)
        self._append("deanonymize", out, column)
        return out

    def preview(self, segments: DataFrame) -> DataFrame:
        """What would be found; nothing is numbered or stored."""
        return mapping.detected(segments, self.recognizers())

    def details(self) -> dict[str, str | int | None]:
        """The summary with when the profile was made and when it was last used (UTC)."""
        dated = self.store.dated()
        last = dated.agg(F.max("last_used")).first()[0] if dated is not None else None
        return {"name": self.name, "created": self.metadata().get("created"), "last_used": last, **self.summary()}

    def reset(self) -> None:
        """Forgets the mapping; the log stays, and says so."""
        self.store.reset()
        gone = self.spark.createDataFrame([(0, 0, "")], "doc_id long, seg_no long, text string").withColumn("entity_counts", F.create_map().cast("map<string,int>"))
        self._append("reset", gone, "text")

    def summary(self) -> dict[str, int]:
        table, log = self.store.load(), self.log()
        return {"mappings": table.count() if table is not None else 0, "log_entries": log.count() if log is not None else 0}


def listed(spark: SparkSession, root: str) -> list[str]:
    """Names of profiles, in order; folders with a leading underscore are hidden."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if not n.startswith("_"))


def anonymize_texts(profile: Profile, texts: list[str], reverse: bool = False) -> list[dict[str, str]]:
    """A request's texts, in their order: [{'input', 'output'}]. The list came from the driver and goes back to it."""
    frame = profile.spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, seg_no long, text string")
    out = profile.deanonymize(frame).select("doc_id", F.col("restored").alias("o")) if reverse else profile.anonymize(frame).select("doc_id", F.col("anonymized").alias("o"))
    done = {r["doc_id"]: r["o"] for r in out.collect()}
    return [{"input": t, "output": done[i]} for i, t in enumerate(texts)]
