"""The mapping of entities to placeholders: encoding, fuzzy merging, decoding, and the stored table.

Entities are numbered by category in order of first appearance: by doc_id, then segment, then, within one
segment, from the right. Existing mappings keep their numbers. Numbers are counted in ranges of documents,
so that no category is numbered by one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwerk.functions import arrays as A
from maskwerk.functions import text as X
from maskwerk.operators import merging
from maskwerk.operators import spans as S
from maskwerk.operators.commits import Commits, Conflict
from maskwerk.operators.recognizers import Recognizer, detect
from maskwerk.plans.tables import written

PLACEHOLDER = "<[A-Z_]+_[0-9]{3,}>"
STORED = "placeholder string, category string, normal_ct binary, original_ct binary, normal_hmac string, use_count long, first_seen string, last_used string"
MAPPING = "placeholder string, category string, normal string, original string, use_count long"
#: Entities of one range of documents, about, in which they are numbered; the number of ranges follows from the data.
RANGE_ROWS = 200_000


def detected(segments: DataFrame, recognizers: Sequence[Recognizer] | None = None) -> DataFrame:
    """segments (doc_id, seg_no, text) with spans; once evaluated, where a plan uses them twice."""
    return segments.withColumn("spans", detect(F.col("text"), recognizers))


def entities(found: DataFrame, full: bool = False) -> DataFrame:
    """A row for each span: doc_id, seg_no, start, category, original and normal."""
    rows = found.select("doc_id", "seg_no", F.explode("spans").alias("s"))
    return rows.select("doc_id", "seg_no", "s.start", "s.category", F.col("s.text").alias("original"), X.normalize(F.col("s.text"), full).alias("normal"))


def first_seen(rows: DataFrame) -> DataFrame:
    """A row for each (category, normal): its place of first appearance, the spelling there, and how often it is used."""
    order = F.struct("doc_id", "seg_no", (-F.col("start")).alias("back"))
    return rows.groupBy("category", "normal").agg(F.min(order).alias("at"), F.min_by("original", order).alias("original"), F.count("*").alias("use_count"))


def merged(keys: DataFrame, existing: DataFrame | None = None, few: int = merging.FEW) -> DataFrame:
    """category, normal, into: which key each new key counts as.

    Keys of other categories count as themselves. Companies that may merge are settled in order of appearance,
    those of the existing mapping first by their numbers, greedily and not transitively, as one client's table
    would grow.
    """
    some = keys.select("category", "normal", F.struct(F.lit(True).alias("new"), F.lit(None).cast("long").alias("number"), "at").alias("order"))
    if existing is not None:
        number = F.regexp_extract("placeholder", r"_([0-9]+)>$", 1).cast("long")
        old = F.struct(F.lit(False).alias("new"), number.alias("number"), F.lit(None).cast(keys.schema["at"].dataType).alias("at"))
        some = some.union(existing.select("category", "normal", old)).groupBy("category", "normal").agg(F.min("order").alias("order"))
    form = F.coalesce(X.legal_form(F.col("normal")), F.lit(""))
    fuzzy = some.filter(F.col("category").isin(*X.FUZZY_CATEGORIES)).withColumn("form", form)
    fuzzy = fuzzy.withColumn("core", X.core_name(F.col("normal"), F.when(F.col("form") != "", F.col("form")))).withColumn("letters", X.letters_only(F.col("core")))
    plain = some.filter(~F.col("category").isin(*X.FUZZY_CATEGORIES)).select("category", "normal", F.col("normal").alias("into"))
    return merging.into(fuzzy, few).union(plain)


def ranged(rows: DataFrame, order: list[str], size: int = RANGE_ROWS) -> DataFrame:
    """rows with part, the number of their range in an order, of any type: ranges hold about `size` rows each.

    The ranges are those of Spark's range partitioning, whose bounds are sampled; the table is written, so that
    a task that runs again cannot see other bounds.
    """
    count = max(1, -(-rows.count() // size))
    return written(rows.repartitionByRange(count, *order).withColumn("part", F.spark_partition_id()), "ranged")


def numbered(keys: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New mappings of keys (first_seen, merged): numbers go on from the largest that exists."""
    keys = ranged(keys, ["category", "at", "normal"])
    sums = keys.groupBy("category", "part").agg(F.count("*").alias("n"))
    # A row for each category and range: as many ranges as the data has RANGE_ROWS.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("category").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("category").alias("c_"), F.col("part").alias("p_"), before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("category", "part").orderBy("at", "normal"))
    rows = keys.withColumn("rank", rank).join(starts, (F.col("category") == F.col("c_")) & (F.col("part") == F.col("p_"))).withColumn("n", F.col("before") + F.col("rank"))
    if existing is not None:
        number = F.regexp_extract("placeholder", r"_([0-9]+)>$", 1).cast("long")
        top = existing.groupBy(F.col("category").alias("t_")).agg(F.max(number).alias("top"))
        rows = rows.join(top, F.col("category") == F.col("t_"), "left").withColumn("n", F.col("n") + F.coalesce("top", F.lit(0)))
    name = F.concat(F.lit("<"), F.col("category"), F.lit("_"), F.when(F.col("n") < 1000, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string")), F.lit(">"))
    return rows.select(name.alias("placeholder"), "category", "normal", "original", "use_count")


def encode(found: DataFrame, existing: DataFrame | None = None, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mapping after these segments, and (category, normal, placeholder, first) for every key they use; first: the spelling that the mapping restores."""
    keys = first_seen(entities(found, full))
    old = existing.select("category", "normal", "placeholder") if existing is not None else None
    into = merged(keys, existing)
    keyed = keys.join(into, ["category", "normal"])
    heads = keyed.groupBy("category", F.col("into").alias("normal")).agg(F.min("at").alias("at"), F.min_by("original", "at").alias("original"), F.sum("use_count").alias("use_count"))
    if existing is None:
        table = numbered(heads)
    else:
        fresh = numbered(heads.join(old, ["category", "normal"], "left_anti"), existing)
        used = heads.select("category", "normal", F.col("use_count").alias("more"))
        kept = existing.join(used, ["category", "normal"], "left").withColumn("use_count", F.col("use_count") + F.coalesce("more", F.lit(0))).select("placeholder", "category", "normal", "original", "use_count")
        table = kept.union(fresh)
    named = table.select(F.col("category").alias("c_"), F.col("normal").alias("n_"), "placeholder", F.col("original").alias("first"))
    codes = into.join(named, (F.col("category") == F.col("c_")) & (F.col("into") == F.col("n_"))).select("category", "normal", "placeholder", "first")
    return table, codes


def _spelled(anonymized: Column, pieces: Column) -> Column:
    """For each placeholder in an anonymised text, in order, what stood there, if the mapping restores something else; null if not.

    pieces: start, end and to, in order, with own, the spelling there if it is not the mapping's. A placeholder
    that was in the text before stands for itself.
    """

    def of(x: Column) -> Column:
        moved = A.running(F.transform(x["pieces"], lambda p: F.length(p["to"]) - p["end"] + p["start"]))
        put = F.zip_with(x["pieces"], moved, lambda p, m: F.struct((p["end"] + m - F.length(p["to"])).alias("at"), F.lit(0).alias("told"), p["own"].alias("own")))
        told = F.transform(X.matches(x["text"], PLACEHOLDER), lambda h: F.struct(h["start"].alias("at"), F.lit(1).alias("told"), h["text"].alias("own")))
        before = lambda o, s, i: F.when(F.get(o, i - 1)["at"] == s["at"], F.get(o, i - 1)["own"]).otherwise(s["own"])
        each = A.let(F.array_sort(F.concat(put, told)), lambda o: F.transform(o, lambda s, i: F.struct(s["told"].alias("told"), before(o, s, i).alias("own"))))
        return F.transform(F.filter(each, lambda s: s["told"] == 1), lambda s: s["own"])

    return A.let(F.struct(anonymized.alias("text"), pieces.alias("pieces")), of)


def anonymize(segments: DataFrame, existing: DataFrame | None = None, recognizers: Sequence[Recognizer] | None = None, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """segments with spans, anonymized, entity_counts and spelled; and the mapping afterwards.

    Codes are joined to spans, not broadcast; texts come back together by segment. spelled has what differs from
    the mapping, such as another case of a spelling that was merged: `deanonymize` restores texts exactly with it.
    """
    found = written(detected(segments, recognizers), "detected")
    table, codes = encode(found, existing, full)
    rows = found.select("doc_id", "seg_no", F.explode("spans").alias("s"))
    rows = rows.withColumns({"category": F.col("s.category"), "normal": X.normalize(F.col("s.text"), full)}).join(codes, ["category", "normal"])
    pieces = F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("placeholder").alias("to"), F.when(F.col("s.text") != F.col("first"), F.col("s.text")).alias("own"))
    by_segment = rows.groupBy(F.col("doc_id").alias("d_"), F.col("seg_no").alias("s_")).agg(F.array_sort(F.collect_list(pieces)).alias("pieces"))
    both = found.join(by_segment, F.col("doc_id").eqNullSafe(F.col("d_")) & F.col("seg_no").eqNullSafe(F.col("s_")), "left").drop("d_", "s_")
    out = F.when(F.col("pieces").isNull(), F.col("text")).otherwise(S.splice(F.col("text"), F.col("pieces"), lambda p: p["to"]))
    both = both.withColumns({"anonymized": out, "entity_counts": S.counts(F.col("spans"))})
    pieces = F.coalesce("pieces", F.array().cast("array<struct<start:int,end:int,to:string,own:string>>"))
    return both.withColumn("spelled", _spelled(F.coalesce("anonymized", F.lit("")), pieces)).drop("pieces"), table


def deanonymize(texts: DataFrame, mapping: DataFrame, column: str = "anonymized") -> DataFrame:
    """texts (doc_id, seg_no, column) with restored, resolved, missing and entity_counts. One pass; unknown placeholders stay.

    With a column spelled, as `anonymize` gives it for the same texts, spellings that were merged come back as they
    were; a placeholder that the text had before stays, and is neither resolved nor missing. Without it each
    placeholder becomes the mapping's spelling.
    """
    own = F.coalesce("spelled", F.array().cast("array<string>")) if "spelled" in texts.columns else F.array().cast("array<string>")
    hits = F.zip_with(X.matches(F.coalesce(F.col(column), F.lit("")), PLACEHOLDER), own, lambda h, o: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["text"].alias("text"), o.alias("own")))
    rows = texts.select("doc_id", "seg_no", F.explode(hits).alias("h")).withColumn("placeholder", F.col("h.text"))
    known = mapping.select("placeholder", "original", "category")
    category = F.when(~F.col("h.own").eqNullSafe(F.col("h.text")), F.col("category"))
    piece = F.struct(F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("h.text").alias("text"), F.coalesce("h.own", "original").alias("original"), category.alias("category"))
    by_segment = rows.join(known, "placeholder", "left").groupBy(F.col("doc_id").alias("d_"), F.col("seg_no").alias("s_")).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    both = texts.join(by_segment, F.col("doc_id").eqNullSafe(F.col("d_")) & F.col("seg_no").eqNullSafe(F.col("s_")), "left").drop("d_", "s_")
    pieces = F.coalesce("pieces", F.array().cast("array<struct<start:int,end:int,text:string,original:string,category:string>>"))
    both = both.withColumn("pieces", pieces)
    known_ = F.filter("pieces", lambda p: p["category"].isNotNull())
    return both.withColumns({
        "restored": F.when(F.size("pieces") == 0, F.col(column)).otherwise(S.splice(F.col(column), F.col("pieces"), lambda p: F.coalesce(p["original"], p["text"]))),
        "resolved": F.transform(known_, lambda p: p["text"]),
        "missing": F.transform(F.filter("pieces", lambda p: p["original"].isNull()), lambda p: p["text"]),
        "entity_counts": S.counts(known_),
    }).drop("pieces")


def missing(texts: DataFrame, mapping: DataFrame, column: str = "anonymized") -> DataFrame:
    """doc_id and placeholder for each placeholder in a text that the mapping lacks, once."""
    rows = texts.select("doc_id", F.explode(X.matches(F.col(column), PLACEHOLDER)).alias("h")).select("doc_id", F.col("h.text").alias("placeholder")).distinct()
    return rows.join(mapping.select("placeholder"), "placeholder", "left_anti").select("doc_id", "placeholder")


class Store:
    """A mapping table of one profile, in a folder of tables, with a commit for each version that names its table.

    Several writers may go on from it at once: `update` makes its table anew from the last version if another
    writer has committed meanwhile. A commit can carry a batch id; a batch that comes again gets the version that
    it made, and adds nothing. Tables whose commit failed stay in the folder and are not read.

    Originals and normal forms are encrypted at rest; equality goes by keyed digest. Keys reach executors in
    functions, not as literals, so that no plan shows them.
    """

    #: How often a writer tries again behind others.
    ATTEMPTS = 50

    def __init__(self, spark, path: str, key: bytes, digest_key: bytes):
        self.spark, self.path, self.key, self.digest_key = spark, path.rstrip("/"), key, digest_key
        self.commits = Commits(spark, f"{self.path}/_commits")
        self._loaded: int | None = None

    def version(self) -> int:
        """The last version's number; -1 if there is none."""
        return self.commits.latest()

    def stored(self, version: int | None = None) -> DataFrame | None:
        """A version, the last one by default, as it is stored: STORED, with ciphertexts, digests and times."""
        version = self.version() if version is None else version
        return self.spark.read.schema(STORED).parquet(f"{self.path}/{self.commits.entry(version)['data']}") if version >= 0 else None

    def _plain(self, rows: DataFrame, *more: str) -> DataFrame:
        key = X.held(self.key)
        plain = lambda c: F.aes_decrypt(F.col(c), key(F.col(c))).cast("string")
        return rows.select("placeholder", "category", plain("normal_ct").alias("normal"), plain("original_ct").alias("original"), "use_count", *more)

    def load(self, version: int | None = None) -> DataFrame | None:
        self._loaded = self.version() if version is None else version
        rows = self.stored(self._loaded)
        return None if rows is None else self._plain(rows)

    def dated(self) -> DataFrame | None:
        """The mapping with first_seen and last_used (UTC, ISO 8601)."""
        rows = self.stored()
        return None if rows is None else self._plain(rows, "first_seen", "last_used")

    def _write(self, table: DataFrame, base: int) -> str:
        """Writes a table that follows a version; its name. A mapping that is new was first seen now; one whose use count has changed was last used now."""
        key, now, last = X.held(self.key), F.lit(datetime.now(UTC).isoformat(timespec="seconds")), self.stored(base)
        hidden = lambda c: F.aes_encrypt(F.col(c), key(F.col(c)))
        if last is None:
            table = table.withColumns({"first_seen": now, "last_used": now})
        else:
            before = last.select(F.col("placeholder").alias("p_"), F.col("use_count").alias("n_"), F.col("first_seen").alias("f_"), F.col("last_used").alias("l_"))
            table = table.join(before, F.col("placeholder") == F.col("p_"), "left")
            table = table.withColumns({"first_seen": F.coalesce("f_", now), "last_used": F.when(F.col("use_count") == F.col("n_"), F.col("l_")).otherwise(now)})
        out = table.select("placeholder", "category", hidden("normal").alias("normal_ct"), hidden("original").alias("original_ct"), X.hmac_sha256(F.col("normal"), self.digest_key).alias("normal_hmac"), "use_count", "first_seen", "last_used")
        name = f"{base + 1:08d}-{uuid.uuid4().hex}"
        out.write.parquet(f"{self.path}/{name}")
        return name

    def save(self, table: DataFrame) -> None:
        """Commits a table as the version behind the one that was loaded last here, or behind the last one; Conflict if another writer has."""
        base = self.version() if self._loaded is None else self._loaded
        if not self.commits.put(base + 1, {"data": self._write(table, base)}):
            raise Conflict(f"version {base + 1} of {self.path} is another writer's")
        self._loaded = base + 1

    def update(self, make: Callable[[DataFrame | None], tuple[Any, DataFrame]], batch: str | None = None) -> Any:
        """make(known) gives a result and the table that follows; the result of the attempt that was committed.

        If the batch has been committed before, the result is made from the version that it made, and nothing is written.
        """
        for _ in range(self.ATTEMPTS):
            base = self.version()
            if batch is not None and (done := self.commits.find("batch", batch)) is not None:
                return make(self.load(done))[0]
            result, table = make(self.load(base))
            entry = {"data": self._write(table, base)} | ({"batch": batch} if batch is not None else {})
            if self.commits.put(base + 1, entry):
                self._loaded = base + 1
                return result
        raise Conflict(f"{self.path}: {self.ATTEMPTS} attempts behind other writers")

    def reset(self) -> None:
        """Deletes all versions. Placeholders in texts that are about cannot be restored any more."""
        self._loaded = None
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def lookup(table: DataFrame, original: Column | str, category: str, digest_key: bytes) -> DataFrame:
    """Stored rows for a spelling, by keyed digest."""
    text = F.lit(original) if isinstance(original, str) else original
    return table.filter((F.col("category") == category) & (F.col("normal_hmac") == X.hmac_sha256(X.normalize(text), digest_key)))
