"""Drop folders of files of all supported kinds, as streams: each file comes out as one of its own kind.

A batch of files is cut into segments, anonymised (or restored) with the profile's mapping, put together again,
checked as a whole by the residual gate, and delivered. What fails or still looks personal is not delivered; a
report has a row for each file, with an error code and what a user may be told. Spark's checkpoint is the
lock of a folder and remembers which files are done; originals can be moved by the source (archive).
"""

from __future__ import annotations

import time
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwerk.operators import mapping
from maskwerk.operators.recognizers import Recognizer
from maskwerk.plans.tables import written
from maskwerk.sources import files
from maskwerk.sources.pdf import DamagedPdf
from maskwerk.streaming.folder import GATE, residual

FILE = "path string, modificationTime timestamp, length long, content binary"
#: What a user is told about an error.
MESSAGES = {
    "unsupported": "Files of this kind are not supported.",
    "damaged": "The file is damaged, or not of the kind that its name says.",
    "protected": "The file is protected by a password.",
    "residual": "The result would still have held personal data. It was not written.",
    "failed": "The file could not be processed.",
}


def error_code(error: Exception) -> str:
    """The code of an error while a file is read or written."""
    if isinstance(error, files.UnsupportedFormat):
        return "unsupported"
    if isinstance(error, RuntimeError) and "password" in str(error).lower():
        return "protected"
    if isinstance(error, (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, DamagedPdf, KeyError, EOFError)):
        return "damaged"
    return "failed"


def message(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), code)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (doc_id, seg_no, text, error): the distinct texts of each file, or one row with its error."""
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                rows += [(path, k, t, None) for k, t in enumerate(files.segments_of(path, content))]
            except Exception as e:  # any error of a file is that file's result
                rows.append((path, -1, None, error_code(e)))
        yield pd.DataFrame(rows, columns=["doc_id", "seg_no", "text", "error"])


def _rebuilt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (path, result, shown, error): the file with its texts replaced, and the text that the gate has to see."""
    for batch in batches:
        rows = []
        for path, content, before, after in zip(batch["path"], batch["content"], batch["before"], batch["after"], strict=True):
            table = dict(zip(before if before is not None else (), after if after is not None else (), strict=True))
            try:
                result = files.rewritten(path, content, lambda t, table=table: table[t] if t else t)
                rows.append((path, result, files.gate_text(path, result), None))
            except Exception as e:
                rows.append((path, None, None, error_code(e)))
        yield pd.DataFrame(rows, columns=["path", "result", "shown", "error"])


def _delivered(folder: str):
    """A function that writes results to a folder, each under a temporary name first; a repeated task writes the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, result in zip(batch["output"], batch["result"], strict=True):
                if name is not None:
                    with system.open_output_stream(f"{root}/_{name}") as f:
                        f.write(result)
                    system.move(f"{root}/_{name}", f"{root}/{name}")
            yield batch[["path", "output", "residual", "error"]]

    return run


def process(batch: DataFrame, store: mapping.Store, reverse: bool = False, recognizers: Sequence[Recognizer] | None = None, times: DataFrame | None = None, batch_id: str | None = None) -> DataFrame:
    """Rows (path, output, result, residual, error) of files (path, content); the store goes on, once for a batch id.

    output is the name to deliver under, null where there is an error. times: path and earlier, how often a path
    has been delivered before; then the name says which time this is.
    """
    batch = written(batch.select("path", "content"), "arrived")
    cut = written(batch.mapInPandas(_cut, "doc_id string, seg_no long, text string, error string"), "cut")
    some = cut.filter("error is null").select("doc_id", "seg_no", "text")
    if reverse:
        known = store.load()
        known = known if known is not None else batch.sparkSession.createDataFrame([], mapping.MAPPING)
        out = mapping.deanonymize(some, known, "text").withColumn("anonymized", F.col("restored"))
    else:
        out = store.update(lambda known: mapping.anonymize(some, known, recognizers), batch_id)
    # The texts of one file, which was in memory whole before.
    pairs = out.groupBy("doc_id").agg(F.collect_list(F.struct("text", "anonymized")).alias("pairs")).select(F.col("doc_id").alias("path"), F.col("pairs.text").alias("before"), F.col("pairs.anonymized").alias("after"))
    bad = cut.filter("error is not null").select(F.col("doc_id").alias("path"), "error")
    whole = batch.join(bad, "path", "left_anti").join(pairs, "path", "left")
    made = whole.mapInPandas(_rebuilt, "path string, result binary, shown string, error string")
    left = F.lit(0) if reverse else residual(F.coalesce("shown", F.lit("")), categories=GATE)
    made = written(made, "made").withColumn("residual", left).withColumn("error", F.when(F.col("residual") > 0, "residual").otherwise(F.col("error")))
    made = made.select("path", "result", "residual", "error").unionByName(bad.select("path", F.lit(None).cast("binary").alias("result"), F.lit(0).alias("residual"), "error"))
    if times is None:
        made = made.withColumn("earlier", F.lit(0))
    else:
        made = made.join(times, "path", "left").na.fill(0, ["earlier"])
    name, mode = F.substring_index("path", "/", -1), "deanon" if reverse else "anon"
    nth = F.when(F.col("earlier") > 0, F.concat(F.lit(" ("), (F.col("earlier") + 1).cast("string"), F.lit(")"))).otherwise("")
    output = F.concat(F.regexp_extract(name, r"^(.*)(\.[^.]*)$", 1), F.lit(f".{mode}"), nth, F.regexp_extract(name, r"^(.*)(\.[^.]*)$", 2))
    return made.select("path", F.when(F.col("error").isNull(), output).alias("output"), "result", "residual", "error")


def settled(batch: DataFrame, seconds: float, most: int = 60) -> DataFrame:
    """Files that nobody writes to any more: those that are young are looked at again until their size stays; then they are read anew."""
    spark = batch.sparkSession
    young = batch.filter(F.col("modificationTime") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(seconds))).select("path", "length").collect()
    if not young:
        return batch
    sizes, changed = {r["path"]: r["length"] for r in young}, set()
    for _ in range(most):
        time.sleep(seconds)
        now = {}
        for p in sizes:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            now[p] = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        moved = {p for p in sizes if now[p] != sizes[p]}
        changed, sizes = changed | moved, now
        if not moved:
            break
    if not changed:
        return batch
    again = spark.read.format("binaryFile").schema(FILE).load(sorted(changed))
    return batch.filter(~F.col("path").isin(*changed)).unionByName(again)


def watch_files(
    spark: SparkSession, folder: str, output: str, report: str, store: mapping.Store, checkpoint: str, reverse: bool = False, recognizers: Sequence[Recognizer] | None = None,
    archive: str | None = None, settle: float = 0.8, once: bool = True, seconds: int = 3, files_each: int = 1000,
) -> StreamingQuery:
    """Starts the stream: files of the folder whose names do not begin with an underscore, `files_each` a batch at most.

    report is a table of Parquet: path, output, residual, error, message, batch. archive: where originals are
    moved to when their batch is done.
    """
    stream = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "[!_]*").option("maxFilesPerTrigger", files_each)
    if archive:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)

    def handle(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        here = spark._jvm.org.apache.hadoop.fs.Path(report)
        times = None
        if here.getFileSystem(spark._jsc.hadoopConfiguration()).exists(here):
            done = spark.read.parquet(report).filter((F.col("batch") < number) & F.col("output").isNotNull())
            times = done.groupBy("path").agg(F.count("*").alias("earlier"))
        made = process(settled(batch, settle) if settle else batch, store, reverse, recognizers, times, f"{checkpoint}#{number}")
        told = made.mapInPandas(_delivered(output), "path string, output string, residual int, error string")
        told.withColumn("message", message(F.col("error"))).write.mode("overwrite").parquet(f"{report}/batch={number}")

    writer = stream.load(folder).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
