"""Secret scans with an incremental ledger of blobs.

Every version of a text is a blob, addressed by its SHA-256. The ledger lists the pairs of blob and rule
version that have been scanned. A scan takes the distinct blobs that lack a pair, runs just the rules
they lack, appends to the ledger, and joins the findings back to all paths that hold the blob. All is
DataFrame expressions; copies of one text are scanned once.

Defined results: a null text is an empty blob; repeated rows and rows with a null id are paths of their
own; an empty table gives no rows; only the path column and text are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwerk.functions import arrays as A
from maskwerk.llm.common import documents, shared_dir
from maskwerk.operators import spans as S

# Kind, pattern, group whose length counts, least length. The first three are the base.
RULES = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    "pem": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 20),
    "slack": (r"xox[abposr]-[A-Za-z0-9-]{10,}", 0, 15),
}
BASE = ("assign", "access", "hex")
VERSION = "1"
#: The setting that names a ledger to go on with; without it, a run has one of its own in the shared folder.
LEDGER = "spark.maskwerk.secrets.ledger"
SPAN = "struct<s:int,k:int,e:int>"


def blob(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def spans(text: Column, kind: str) -> Column:
    """Matches of a kind that are long enough: array of (start, number of the kind, end), in code points.

    Splitting at the pattern gives what lies between the matches; running sums of both lengths give places.
    """
    pattern, group, least = RULES[kind]
    number = list(RULES).index(kind)
    told = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    # What lies between has one more element, which has no match and is dropped.
    ends = A.running(F.zip_with(F.split(text, pattern, -1), told(0), lambda gap, whole: F.length(gap) + F.length(whole)))
    sizes = F.transform(told(0), lambda x: F.struct(F.length(x).alias("n"), F.length(x).alias("told")))
    if group:
        sizes = F.zip_with(told(0), told(group), lambda x, t: F.struct(F.length(x).alias("n"), F.length(t).alias("told")))
    every = F.zip_with(ends, sizes, lambda e, x: F.struct(e.alias("e"), x["n"].alias("n"), x["told"].alias("told")))
    found = F.transform(F.filter(every, lambda x: x["told"] >= least), lambda x: F.struct((x["e"] - x["n"]).alias("s"), F.lit(number).alias("k"), x["e"].alias("e")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(blobs: DataFrame, kinds: list[str]) -> DataFrame:
    """blob, rule and its spans for each kind; blobs needs blob, text and lacking (array of kinds)."""
    found = [F.when(F.array_contains("lacking", k), F.struct(F.lit(k).alias("rule"), spans(F.col("text"), k).alias("spans"))) for k in kinds]
    return blobs.select("blob", F.explode(F.array_compact(F.array(*found))).alias("f")).select("blob", "f.rule", "f.spans")


def unseen(docs: DataFrame, ledger: DataFrame | None, kinds: list[str], version: str = VERSION) -> DataFrame:
    """Distinct blobs with text that some kind has not scanned in this version, and which kinds those are."""
    texts = docs.select(blob().alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        return texts.withColumn("lacking", F.array(*map(F.lit, kinds)))
    seen = ledger.filter(F.col("version") == version).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    lacking = F.array_except(F.array(*map(F.lit, kinds)), F.coalesce("seen", F.array().cast("array<string>")))
    return texts.join(seen, "blob", "left").select("blob", "text", lacking.alias("lacking")).filter(F.size("lacking") > 0)


def scan_versions(docs: DataFrame, path: str, kinds: list[str] | None = None, version: str = VERSION) -> DataFrame:
    """Scans what the ledger at `path` has not seen, appends to it, and returns the findings of all blobs of docs.

    The ledger's rows are blob, rule, spans and version; a run that is repeated finds its blobs seen.
    """
    spark, kinds = docs.sparkSession, kinds or list(RULES)
    schema = f"blob string, rule string, spans array<{SPAN}>, version string"
    try:
        ledger = spark.read.schema(schema).parquet(path)
        ledger.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = None
    scan(unseen(docs, ledger, kinds, version), kinds).withColumn("version", F.lit(version)).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).filter((F.col("version") == version) & F.col("rule").isin(kinds))


def by_blob(findings: DataFrame) -> DataFrame:
    """A row (_blob, _found) for each blob with any finding: its spans of all kinds, by start, then kind."""
    some = findings.filter(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return some.select(F.col("blob").alias("_blob"), F.sort_array("spans").alias("_found"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, RULES))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scanned(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs named in keep (doc_id alone by default) with found, the spans in each row's text; no ledger is kept."""
    kinds = list(RULES)
    each = [F.when(F.array_contains("lacking", k), spans(F.col("text"), k)) for k in kinds]
    found = unseen(docs, None, kinds).select(F.col("blob").alias("_blob"), F.sort_array(F.flatten(F.array_compact(F.array(*each)))).alias("_found"))
    return joined_to_paths(docs, found.filter(F.size("_found") > 0), keep or ["doc_id"])


def joined_to_paths(docs: DataFrame, found: DataFrame, keep: list[str]) -> DataFrame:
    """Columns of docs with found (empty if none), from rows (_blob, _found)."""
    paths = docs.select(*keep, blob().alias("_path_blob"))
    return paths.join(found, F.col("_path_blob") == F.col("_blob"), "left").select(*keep, F.coalesce("_found", F.array().cast(f"array<{SPAN}>")).alias("found"))


def redacted(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """text with each stretch that spans cover replaced by mask."""
    places = F.transform(found, lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end")))
    return F.when(F.size(found) == 0, text).otherwise(S.splice(text, S.covered(places), lambda x: F.lit(mask)))


def ledger_path(spark: SparkSession) -> str:
    return spark.conf.get(LEDGER, None) or f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = joined_to_paths(docs, by_blob(scan_versions(docs, ledger_path(spark))), ["doc_id"])
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == BASE.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda x: x["k"] < len(BASE))
    return out.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
