"""Corpus pipeline: quality rules, near-duplicate join, suffix dedup, secret scan, packing.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns packed
pieces. Between stages the driver, or run(), writes Parquet.

For all stages: documents need the five columns of COLUMNS, and a column that is missing is an error of the
plan; others are ignored. A null text counts as empty, null sources and languages are values of their own,
rows that share a doc_id are documents of their own, and an empty table gives an empty one. n_chars is made
anew where the text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwerk.llm import ngrams, packing, quality, secrets, suffixes
from maskwerk.llm.common import documents, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Empty and null texts fail by their length; a null or unlisted lang has no verdict by divergence."""
    return quality.judged(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles: the one with the smallest id.

    Five words and 0.8 are what near-duplicate stages take by default; op10 has four and 0.85 by its contract.
    Of rows that share that id, the least text, lang, source stays. Documents without words are linked with
    nothing, and stay.
    """
    return ngrams.representatives(docs.select(*COLUMNS)).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that a document with a smaller id holds.

    Characters of which bytes are left over at an edge go; a text may become empty and stays as a row. Rows
    without doc_id stay as they are.
    """
    out = suffixes.dedup(docs.select(*COLUMNS), keep=["lang", "source"])
    return out.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the secrets in them masked; what overlaps is masked once. A null text stays null.

    Texts go through the ledger of blobs, a new one for each run unless the setting of secrets.LEDGER names one.
    """
    rows = docs.select(*COLUMNS)
    found = secrets.by_blob(secrets.scan_versions(rows, secrets.ledger_path(spark)))
    out = secrets.joined_to_paths(rows, found, COLUMNS).withColumn("text", secrets.redacted(F.col("text"), F.col("found")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 2048 tokens, mixed by source in the proportions of the corpus; an empty text is an end id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", suffix_dedup), ("secret scans", secret_scan), ("packing", packed)]

#: SQL cannot express packing; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
