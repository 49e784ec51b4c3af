"""A log of numbered commits in a folder, which several writers append to at once.

An entry is a small file of JSON, named by its number and put in place whole and only if that number is free: by
a hard link on a local file system, by a rename that does not replace on HDFS and its like, and by creation
without overwriting elsewhere, which object stores must do atomically. A writer whose number is taken reads
what has come in between and tries the next one.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File systems whose rename fails where the target is there.
RENAMING = ("hdfs", "viewfs", "webhdfs", "swebhdfs", "abfs", "abfss")


class Conflict(RuntimeError):
    """Another writer has been faster."""


class Commits:
    """Entries 0, 1, 2 ... of one folder; keys of an entry are strings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def latest(self) -> int:
        """The last entry's number; -1 if there is none."""
        if not self.fs.exists(self._path()):
            return -1
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path())]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit()), default=-1)

    def entry(self, number: int) -> dict[str, str]:
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/{number:012d}.json").first()[0])

    def find(self, key: str, value: str) -> int | None:
        """The first entry that has this value, found by Spark: a log may be long."""
        if self.latest() < 0:
            return None
        rows: DataFrame = self.spark.read.option("pathGlobFilter", "[0-9]*.json").text(self.path)
        number = F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9]+)", 1).cast("long")
        return rows.filter(F.get_json_object("value", f"$.{key}") == value).agg(F.min(number)).first()[0]

    def put(self, number: int, entry: dict[str, str]) -> bool:
        """Whether the entry has become this number; False if there is one already."""
        self.fs.mkdirs(self._path())
        final = self._path(f"{number:012d}.json")
        scheme = self.fs.getUri().getScheme()
        passing = final if scheme not in (*RENAMING, "file") else self._path(f"_{uuid.uuid4().hex}")
        try:
            out = self.fs.create(passing, False)
        except Py4JJavaError as e:
            if passing is final and "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(json.dumps(entry, sort_keys=True).encode())
        out.close()
        if passing is final:
            return True
        try:
            if scheme != "file":
                return not self.fs.exists(final) and self.fs.rename(passing, final)
            local = [self.jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, passing)]
            self.jvm.java.nio.file.Files.createLink(*local)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            self.fs.delete(passing, False)
