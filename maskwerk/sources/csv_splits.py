r"""CSV records of files that many tasks read at once, quoted line feeds included.

Spark's text source cuts a file into blocks and gives whole lines, but a line may be a record, part of a quoted
field, or both. So a first pass tells for each block, for either state at its start (between records; within
quotes), the state at its end and how many records end in it. Such a function of two states is a constant, the
identity or an exchange: the state at a block's start is that of the last constant before it, exchanged as often
as blocks in between do so, which are two running sums in a window over the blocks of a file. The second pass
knows the state and the record's number where its block begins. A record that goes on in the next block is
put together from its pieces; no other text is shuffled.

A field is quoted if a quotation mark begins it; two within it stand for one; what follows the mark that
ends it belongs to the field as it is. A record ends with a line feed, with or without a carriage return before
it, or with the file. Records are numbered from 0 in their file, empty ones too; a byte order mark goes.
The line feed that ends a file is no part of a field that is left open.
A record of more than MOST_RECORD characters, as an open quotation mark makes it, ends the job with an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwerk.plans.tables import written

#: Blocks whose starts every task may hold, about 150 bytes each; beyond it lines are joined to the starts of their blocks.
MOST_BLOCKS = 50_000
MOST_RECORD = 64 << 20

CLOSE = re.compile(r'(?:[^"]+|"")*+"')
BLOCK = "path string, block long, out_end boolean, out_records long, in_end boolean, in_records long"
PIECE = "path string, row long, block long, text string, whole boolean"
PIECES = pa.schema([("path", pa.string()), ("row", pa.int64()), ("block", pa.int64()), ("text", pa.string()), ("whole", pa.bool_())])


def inside_at_end(line: str, inside: bool, sep: str) -> bool:
    """Whether a line ends within quotes, from whether it begins so."""
    if '"' not in line:
        return inside
    at = 0
    if not inside:
        if not line.startswith('"'):
            if (at := line.find(f'{sep}"')) < 0:
                return False
            at += len(sep)
        at += 1
    while True:
        if not (end := CLOSE.match(line, at)):
            return True
        if (at := line.find(f'{sep}"', end.end())) < 0:
            return False
        # The text behind a closing mark belongs to its field, up to the next separator.
        at += len(sep) + 1


def fields(record: str, sep: str) -> list[str]:
    """The fields of a record; an empty one has one empty field."""
    out, at = [], 0
    while True:
        text = ""
        if record.startswith('"', at):
            end = CLOSE.match(record, at + 1)
            stop = end.end() - 1 if end else len(record)
            text, at = record[at + 1 : stop].replace('""', '"'), stop + 1
        next_ = record.find(sep, at)
        out.append(text + (record[at:] if next_ < 0 else record[at:next_]))
        if next_ < 0:
            return out
        at = next_ + len(sep)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block and line, in order within a block."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _blocks(sep: str):
    """Rows of BLOCK for lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, ended = None, [False, True], [0, 0]

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [key[0]], "block": [key[1]], "out_end": [states[0]], "out_records": pa.array([ended[0]], pa.int64()), "in_end": [states[1]], "in_records": pa.array([ended[1]], pa.int64())})

        for batch in batches:
            for path, block, line in zip(batch["path"].to_pylist(), batch["block"].to_pylist(), batch["line"].to_pylist(), strict=True):
                if (path, block) != key:
                    if key:
                        yield done()
                    key, states, ended = (path, block), [False, True], [0, 0]
                for k in (0, 1):
                    states[k] = inside_at_end(line, states[k], sep)
                    ended[k] += not states[k]
        if key:
            yield done()

    return run


def starts(blocks: DataFrame) -> DataFrame:
    """path, block, inside and row: the state at each block's start, and the number of the record that goes on or begins there."""
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    constant, exchange = F.col("out_end") == F.col("in_end"), F.col("out_end") & ~F.col("in_end")
    rows = blocks.withColumn("n", F.sum(exchange.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # What a constant block leaves, as if no exchange had been before it.
    rows = rows.withColumn("left", F.when(constant, F.col("out_end") != (F.col("n") % 2 == 1)))
    odd = F.coalesce(F.max("n").over(before), F.lit(0)) % 2 == 1
    rows = rows.withColumn("inside", F.coalesce(F.last("left", ignorenulls=True).over(before), F.lit(False)) != odd)
    ended = F.when(F.col("inside"), F.col("in_records")).otherwise(F.col("out_records"))
    return rows.withColumn("row", F.coalesce(F.sum(ended).over(before), F.lit(0))).select("path", "block", "inside", "row")


def _pieces(sep: str, most: int):
    """Rows of PIECE for lines with the state and the record's number at their block's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, first, inside, held, size, out = None, 0, False, False, [], 0, []

        def flush() -> list[dict]:
            """The piece that is held: the block ends within its record, or the record began before the block."""
            return [{"path": key[0], "row": row, "block": key[1], "text": "\n".join(held), "whole": False}] if held else []

        for batch in batches:
            for path, block, at_start, number, line in zip(*(batch[c].to_pylist() for c in ("path", "block", "inside", "row", "line")), strict=True):
                if (path, block) != key:
                    out += flush() if key else []
                    key, row, inside, first, held, size = (path, block), number or 0, bool(at_start), bool(at_start), [], 0
                held.append(line)
                size += len(line) + 1
                if size > most:
                    raise ValueError(f"{path}: a record of over {most} characters; is a quotation mark open?")
                inside = inside_at_end(line, inside, sep)
                if not inside:
                    # A record that began before this block waits for its other pieces.
                    out += flush() if first else [{"path": path, "row": row, "block": block, "text": "\n".join(held), "whole": True}]
                    row, held, size, first = row + 1, [], 0, False
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, PIECES)
                out = []
        out += flush() if key else []
        yield pa.RecordBatch.from_pylist(out, PIECES)

    return run


def records(spark: SparkSession, path: str, sep: str, most_blocks: int = MOST_BLOCKS, most: int = MOST_RECORD) -> DataFrame:
    """path, row (from 0) and text of each record of a file, or of a folder's or pattern's files."""
    lines = _lines(spark, path)
    known = starts(written(lines.mapInArrow(_blocks(sep), BLOCK), "csv-blocks")).filter("inside or row > 0")
    known = written(known.select(F.col("path").alias("p_"), F.col("block").alias("b_"), "inside", "row"), "csv-starts")
    same = (F.col("path") == F.col("p_")) & (F.col("block") == F.col("b_"))
    if known.limit(most_blocks + 1).count() <= most_blocks:
        rows = lines.join(F.broadcast(known), same, "left")
    else:
        rows = lines.withColumn("at", F.monotonically_increasing_id()).join(known.hint("merge"), same, "left").repartition("path", "block").sortWithinPartitions("path", "block", "at")
    pieces = written(rows.select("path", "block", "inside", "row", "line").mapInArrow(_pieces(sep, most), PIECE), "csv-pieces")
    size = F.sum(F.length("text").cast("long"))
    joined = pieces.filter("not whole").groupBy("path", "row").agg(size.alias("n"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))
    said = F.concat(F.col("path"), F.lit(f": a record of over {most} characters; is a quotation mark open?"))
    text = F.when(F.col("n") > most, F.raise_error(said)).otherwise(F.array_join(F.col("p.text"), "\n"))
    whole = pieces.filter("whole").select("path", "row", "text").unionByName(joined.select("path", "row", text.alias("text")))
    first = F.when(F.col("row") == 0, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text"))
    return whole.select("path", "row", F.regexp_replace(first, r"\r\z", "").alias("text"))


def cells(rows: DataFrame, sep: str) -> DataFrame:
    """path, row, col (from 0) and text of the fields of records (path, row, text) that are not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = [(p, r, c, x) for p, r, t in zip(part["path"].to_pylist(), part["row"].to_pylist(), part["text"].to_pylist(), strict=True) for c, x in enumerate(fields(t, sep)) if x]
                yield pa.RecordBatch.from_pydict({n: pa.array([o[k] for o in out], kind) for k, (n, kind) in enumerate((("path", pa.string()), ("row", pa.int64()), ("col", pa.int64()), ("text", pa.string())))})

    return rows.select("path", "row", "text").mapInArrow(run, "path string, row long, col long, text string")
