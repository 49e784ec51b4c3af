"""Queries for merging in rounds, several writers, many patterns in one pass, cut files and rate limits, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwerk.operators import answers, mapping, recognizers, scoring
from maskwerk.operators import segments as segments_
from maskwerk.plans.more_queries import _HALVES, QUERIES, SQL  # noqa: F401
from maskwerk.plans.queries import KEY, only, query, segments, table
from maskwerk.plans.tables import shared_dir, written
from maskwerk.sources import csv_splits

_LETTERS = "translate(lpad({n}, 12, '0'), '0123456789', 'abcdefghij')"


@query(f"""with recursive names as (select c_custkey::bigint as key, {_LETTERS.format(n="c_custkey::varchar")} as core, case when c_custkey % 3 = 0 then 'ag' else 'gmbh' end as form, row_number() over (order by c_custkey) as i from customer),
fold(i, kept, key, head) as (select 0::bigint, []::struct(core varchar, form varchar)[], null::bigint, null::varchar
    union all select i + 1, case when hit is null then list_append(kept, {{'core': core, 'form': form}}) else kept end, key, coalesce(hit, core || ' ' || form)
    from (select fold.i, kept, names.key, core, form, list_transform(list_filter(kept, lambda x: x.form = names.form and levenshtein(x.core, names.core) <= 1), lambda x: x.core || ' ' || x.form)[1] as hit from fold join names on names.i = fold.i + 1))
select key, head from fold where key is not null""")
def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company names one letter apart, in order of their customers: which accepted name each counts as, in rounds."""
    key = F.col(KEY).cast("long")
    name = F.concat_ws(" ", F.expr(_LETTERS.format(n=f"cast({KEY} as string)")), F.when(key % 3 == 0, "ag").otherwise("gmbh"))
    names = written(table(spark, sf_dir, "customer").select(key.alias("key"), F.lit("COMPANY").alias("category"), name.alias("normal"), F.struct(key.alias("doc_id"), F.lit(0).alias("seg_no"), F.lit(0).alias("back")).alias("at")), "names")
    into = mapping.merged(names.select("category", "normal", "at"), few=0).select(F.col("normal").alias("n_"), F.col("into").alias("head"))
    return names.join(into, F.col("normal") == F.col("n_")).select("key", "head")


@query(f"with {_HALVES.replace('doc_id % 2 as half', '1 - doc_id % 2 as half')} select '<EMAIL_' || lpad(k::varchar, greatest(3, len(k::varchar))::int, '0') || '>' as placeholder, n as normal, original, use_count from (select *, row_number() over (order by half, case when half = 0 then a else b end) as k from firsts)")
def two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """While one writer makes its table, another commits; then the other's batch comes again. Nothing is lost, nothing is counted twice."""
    docs, path = segments(table(spark, sf_dir, "documents")), f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    one, two = (mapping.Store(spark, path, b"k" * 32, b"digest") for _ in range(2))
    odd = lambda known: mapping.anonymize(docs.filter("doc_id % 2 = 1"), known, only("email"))
    came: list[DataFrame] = []

    def even(known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        if not came:
            came.append(two.update(odd, "odd"))
        return mapping.anonymize(docs.filter("doc_id % 2 = 0"), known, only("email"))

    one.update(even, "even")
    two.update(odd, "odd")
    return one.load().drop("category")


_WORDS = "words as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) as w from benchmark)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of seven letters or more in the benchmark's items, in lower case."""
    return table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("w")).distinct()


@query(f"""with {_WORDS} select doc_id, sum((length(text) - length(replace(lower(text), w, ''))) // length(w))::bigint as n
from documents, words group by doc_id""")
def many_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the benchmark's long words, as custom terms, stand in each document, in any case, with all of them in one pass."""
    words = [r["w"] for r in _words(spark, sf_dir).collect()]
    found = recognizers.detect(F.col("text"), [recognizers.terms(words, few=0)], resolved=False)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"))


@query(f"with {_WORDS} select w as keyword, count(*) filter (contains(lower(text), w))::bigint as n_files from words, documents group by w")
def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each long word of the benchmark."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return scoring.coverage(_words(spark, sf_dir).withColumnRenamed("w", "keyword"), files)


@query("select doc_id::varchar as doc_id, length(text)::bigint as n_chars, md5(text) as digest, true as gapless from documents where text <> ''")
def csv_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through CSV files: quoted texts with line feeds come back whole, and the rows of each file are numbered without gaps."""
    path = f"{shared_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "text").filter("text <> ''").write.csv(path, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = written(csv_splits.records(spark, path, ","), "csv-rows")
    sizes = rows.groupBy(F.col("path").alias("p_")).agg((F.max("row") + 1 == F.countDistinct("row")).alias("gapless"))
    cells = csv_splits.cells(rows, ",").withColumn("doc_id", F.when(F.col("col") == 0, F.col("text")))
    both = cells.groupBy("path", "row").agg(F.max("doc_id").alias("doc_id"), F.max(F.when(F.col("col") == 1, F.col("text"))).alias("text"))
    return both.join(sizes, F.col("path") == F.col("p_")).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"), "gapless")


@query("select doc_id, len(list_distinct(regexp_extract_all(coalesce(text, ''), '[a-z]{12,}')))::bigint as n_values from documents")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that names long words is asked once for each text; the second run must not ask, and has all answers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = answers.Answers(spark, f"{shared_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}", "long words 1")

    def ask(texts):
        import re

        return texts.map(lambda t: [{"text": w, "type": "COMPANY"} for w in dict.fromkeys(re.findall("[a-z]{12,}", t))])

    def refuse(texts):
        raise RuntimeError("asked again")

    store.answered(docs, ask)
    return store.answered(docs, refuse).select("doc_id", F.size("values").cast("long").alias("n_values"))


@query("select c_custkey::bigint as key, c_custkey::bigint % 2 as commit, true as ok from customer")
def segmented_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of entries, in segments that tasks of their own have hashed: each entry's segment is as its commit says."""
    log = segments_.SegmentedLog(spark, f"{shared_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}")
    rows = table(spark, sf_dir, "customer").select(F.col(KEY).cast("long").alias("seq"), F.concat(F.lit("key "), F.col(KEY).cast("string")).alias("operation"), *[F.lit("x").alias(c) for c in segments_.FIELDS if c not in ("operation", "prev_hash")])
    for half in (0, 1):
        log.append(rows.filter(F.col("seq") % 2 == half), 400)
    checked = log.verified().select(F.col("commit").alias("c_"), F.col("segment").alias("s_"), "ok")
    entries = log.entries().select(F.substring("operation", 5, 20).cast("long").alias("key"), "commit", "segment")
    return entries.join(checked, (F.col("commit") == F.col("c_")) & (F.col("segment") == F.col("s_"))).select("key", "commit", "ok")
