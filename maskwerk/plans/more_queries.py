"""More queries, for operators that those of `queries` do not reach, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwerk.functions import text as X
from maskwerk.operators import audit, mapping, permute, recognizers, scoring
from maskwerk.operators import spans as S
from maskwerk.plans import arena
from maskwerk.plans.queries import _CODES, _EXPECTED, _MAILS, KEY, LETTERS, QUERIES, SQL, letters, only, query, segments, table
from maskwerk.plans.tables import dealt, shared_dir, written
from maskwerk.streaming import folder


def _found_in_text(spark: SparkSession, sf_dir: str, checked: str, name: str, shown: Column) -> DataFrame:
    """How many spans a recogniser finds around the candidates of a checksum query, shown in one of its spellings."""
    rows = QUERIES[checked](spark, sf_dir).withColumn("text", F.concat(F.lit("nr. "), shown, F.lit(", ende")))
    return rows.select("key", F.size(recognizers.detect(F.col("text"), only(name))).cast("long").alias("n"))


def _as_found(checked: str) -> str:
    return f"select key, valid::int::bigint as n from ({SQL[checked]})"


def _spelled(*forms: Column) -> Column:
    """One of some spellings of the candidate, by the key."""
    return F.element_at(F.array(*forms), (F.pmod(F.col("key"), F.lit(len(forms))) + 1).cast("int"))


def _grouped(sizes: list[int], sep: str) -> Column:
    starts = [1 + sum(sizes[:i]) for i in range(len(sizes))]
    return F.concat_ws(sep, *[F.substring("candidate", a, n) for a, n in zip(starts, sizes, strict=True)])


@query(_as_found("iban_validate"))
def detect_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found_in_text(spark, sf_dir, "iban_validate", "iban", _spelled(F.col("candidate"), _grouped([4] * 5, " ")))


@query(_as_found("svnr_validate"))
def detect_svnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found_in_text(spark, sf_dir, "svnr_validate", "at_svnr", _spelled(F.col("candidate"), _grouped([4, 6], " ")))


@query(_as_found("at_uid_validate"))
def detect_at_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found_in_text(spark, sf_dir, "at_uid_validate", "at_uid", F.col("candidate"))


@query(_as_found("de_uid_validate"))
def detect_de_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found_in_text(spark, sf_dir, "de_uid_validate", "de_uid", F.col("candidate"))


@query(_as_found("de_tax_id_validate"))
def detect_tax_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found_in_text(spark, sf_dir, "de_tax_id_validate", "de_tax_id", _spelled(F.col("candidate"), _grouped([2, 3, 3, 3], " ")))


@query(_as_found("ahv_validate"))
def detect_ahv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found_in_text(spark, sf_dir, "ahv_validate", "ch_ahv", _spelled(F.col("candidate"), _grouped([3, 4, 4, 2], "."), _grouped([3, 4, 4, 2], "-")))


@query(_as_found("card_validate"))
def detect_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found_in_text(spark, sf_dir, "card_validate", "card", _spelled(F.col("candidate"), _grouped([4] * 4, " "), _grouped([4] * 4, "-")))


@query("select c_custkey::bigint as key, case when c_custkey % 4 = 3 then 0 else 1 end::bigint as n from customer")
def detect_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two issuers, a named token, and a name with too short a value."""
    made = F.expr(f"""case {KEY} % 4 when 0 then concat('sk-', substring(sha2(c_name, 256), 1, 32)) when 1 then concat('AKIA', upper(substring(sha2(c_name, 256), 1, 16)))
        when 2 then concat('token = ', substring(sha2(c_name, 256), 1, 24)) else concat('token = ', substring(sha2(c_name, 256), 1, 19)) end""")
    rows = table(spark, sf_dir, "customer").select(F.col(KEY).cast("long").alias("key"), F.concat(F.lit("mit "), made, F.lit(" ende")).alias("text"))
    return rows.select("key", F.size(recognizers.detect(F.col("text"), only("secret"))).cast("long").alias("n"))


@query("select c_custkey::bigint as key, len(regexp_extract_all(c_name || ' ' || c_mktsegment, 'Customer#[0-9]{3}'))::bigint as n from customer")
def client_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client number by a user's pattern in Python's dialect."""
    some = [recognizers.user_pattern(r"Customer#(?P<n>\d{3})")]
    rows = table(spark, sf_dir, "customer").select(F.col(KEY).cast("long").alias("key"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    return rows.select("key", F.size(recognizers.detect(F.col("text"), some)).cast("long").alias("n"))


@query("select p_partkey::bigint as key, len(regexp_extract_all(lower(p_type), 'steel')) + len(regexp_extract_all(lower(p_type), 'an')) as n from part")
def custom_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of two custom terms in any case."""
    some = [recognizers.terms(["Steel", "AN", "x", " "])]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("key"), F.size(recognizers.detect(F.col("p_type"), some)).cast("long").alias("n"))


@query(f"select * from ({_EXPECTED})")
def counts_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that go to the audit log, category by category."""
    found = mapping.detected(segments(letters(spark, sf_dir)))
    return found.select("doc_id", F.explode(S.counts(F.col("spans"))).alias("category", "n")).withColumn("n", F.col("n").cast("long"))


@query(f"select key, valid::int::bigint as residual, not valid as passed from ({SQL['at_uid_validate']})")
def gate_by_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that still hold an identifier: stopped where its check digit is right."""
    rows = QUERIES["at_uid_validate"](spark, sf_dir).select("key", F.concat(F.lit("An <PERSON_001>, UID "), "candidate").alias("anonymized"), S.none().alias("spans"))
    return folder.gated(rows).select("key", F.col("residual").cast("long").alias("residual"), "passed")


def _pads(key: bytes) -> tuple[str, str]:
    block = key.ljust(64, b"\0")
    return tuple(bytes(x ^ pad for x in block).hex() for pad in (0x36, 0x5C))


_INNER, _OUTER = _pads(b"test key")


@query(f"select c_custkey::bigint as key, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(c_name)))) as digest from customer")
def keyed_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col(KEY).cast("long").alias("key"), X.hmac_sha256(F.col("c_name"), b"test key").alias("digest"))


@query(f"with {_CODES} select placeholder, original from codes where n in (select n from codes order by n limit 20)")
def stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings looked up in an encrypted store by spellings in another case, through keyed digests."""
    docs = segments(table(spark, sf_dir, "documents"))
    store = mapping.Store(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}", b"k" * 32, b"digest")
    store.save(mapping.anonymize(docs, recognizers=only("email"))[1])
    wanted = store.load().orderBy("normal").limit(20).select(X.hmac_sha256(X.normalize(F.upper("original")), b"digest").alias("normal_hmac"))
    hits = store.stored().join(wanted, "normal_hmac").select("placeholder")
    return store.load().join(hits, "placeholder").select("placeholder", "original")


_HALVES = f"""mails as (select doc_id, unnest(m) as e, unnest(range(len(m))) as i from {_MAILS}),
normal as (select *, trim(regexp_replace(regexp_replace(lower(e), '[^a-z0-9_&. ]', ' ', 'g'), ' +', ' ', 'g')) as n, doc_id % 2 as half from mails),
firsts as (select n, min(half) as half, min((doc_id, -i)) filter (half = 0) as a, min((doc_id, -i)) filter (half = 1) as b, arg_min(e, (half, doc_id, -i)) as original, count(*) as use_count from normal group by n)"""


@query(f"with {_HALVES} select '<EMAIL_' || lpad(k::varchar, greatest(3, len(k::varchar))::int, '0') || '>' as placeholder, n as normal, original, use_count from (select *, row_number() over (order by half, case when half = 0 then a else b end) as k from firsts)")
def encode_in_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch goes on from the first one's mapping: numbers go on, uses add up, first spellings stay."""
    docs = segments(table(spark, sf_dir, "documents"))
    first = written(mapping.anonymize(docs.filter("doc_id % 2 = 0"), recognizers=only("email"))[1], "first")
    return mapping.anonymize(docs.filter("doc_id % 2 = 1"), first, only("email"))[1].drop("category")


def _seeds(column: str) -> tuple[int, int]:
    key = permute.key_from_secret(b"test")
    return permute.seed_for(key, column, "place"), permute.seed_for(key, column, "value")


_PLACE, _VALUE = _seeds("o_totalprice")


@query(f"""with places as (select o_orderkey, row_number() over (order by sha256('{_PLACE}|' || o_orderkey), o_orderkey) as k from orders),
moved as (select o_totalprice, row_number() over (order by sha256('{_VALUE}|' || o_orderkey), o_orderkey) as k from orders)
select o_orderkey, moved.o_totalprice from places join moved using (k)""")
def permuted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the price that the keyed permutation gives it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return permute.spread(orders, "o_orderkey", "o_totalprice", permute.key_from_secret(b"test"), parts=13)


_LOG = """with recursive e as (select row_number() over (order by c_custkey) as id, '2026-01-01T00:00:00+00:00' as ts, 'anonymize' as op, '{"EMAIL":' || c_custkey % 9 || '}' as counts, sha256(c_name) as th, 'n/a' as mv, '1.0.0' as rv from customer),
chain as (select 0::bigint as id, repeat('0', 64) as h, '' as prev union all select e.id, sha256(concat_ws('|', ts, op, counts, th, mv, rv, chain.h)), chain.h from chain join e on e.id = chain.id + 1)"""


def _customer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col(KEY).cast("long").alias("seq"), F.lit("2026-01-01T00:00:00+00:00").alias("timestamp_utc"), F.lit("anonymize").alias("operation"),
        X.counts_json(F.create_map(F.lit("EMAIL"), (F.col(KEY) % 9).cast("int"))).alias("entity_counts_json"), F.sha2("c_name", 256).alias("anonymized_text_sha256"),
        F.lit("n/a").alias("model_version"), F.lit("1.0.0").alias("recognizer_version"),
    )
    return audit.append(rows)


@query(f"{_LOG} select id, h as hash from chain order by id desc limit 1")
def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry, from which the next one goes on."""
    return spark.createDataFrame([audit.tail(_customer_log(spark, sf_dir))], "id long, hash string")


@query("select row_number() over (order by c_custkey) as id, row_number() over (order by c_custkey) % 100 not in (7, 8, 50) as ok from customer")
def audit_tampered_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth entry has other counts, another a forged hash: the entry itself fails, behind a forged hash the next one too."""
    log = written(_customer_log(spark, sf_dir), "log")
    at = F.col("id") % 100
    counts = F.when(at == 50, F.lit('{"EMAIL":99}')).otherwise(F.col("entity_counts_json"))
    return audit.checked(log.withColumns({"entity_counts_json": counts, "this_hash": F.when(at == 7, F.reverse("this_hash")).otherwise(F.col("this_hash"))}))


SQL["rate_limit"] = """with recursive e as (select user_id::varchar as client, floor(epoch(ts::timestamp))::double as "at", row_number() over (partition by user_id order by floor(epoch(ts::timestamp))) as k from events),
run as (select client, "at", k, 3.0::double as before from e where k = 1
    union all select e.client, e."at", e.k, least(3.0::double, (case when run.before >= 1 then run.before - 1 else run.before end) + (e."at" - run."at") * 0.001::double) from run join e on e.client = run.client and e.k = run.k + 1)
select client, "at", before >= 1 as allowed, case when before >= 1 then 0.0::double else (1 - before) / 0.001::double end as retry_after from run"""


# ---------------------------------------------------------------- the arena

_KEYS = "(select c_custkey::bigint as i from customer) t"


def _letters_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer."""
    return arena.filled(table(spark, sf_dir, "customer").select(F.col(KEY).cast("long").alias("doc_id")))


@query(f"""select case (i // 6) % 4 when 0 then 'clean' when 1 then 'reflow' when 2 then 'spacing' else 'list' end as mode, case (i // 24) % 3 when 0 then 'AT' when 1 then 'DE' else 'CH' end as country,
    sum(case i % 6 when 0 then 4 when 1 then 4 when 2 then 4 when 3 then 4 when 4 then 3 else 4 end)::bigint as secrets from {_KEYS} group by all""")
def arena_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of the arena by mode and country."""
    return arena.secrets(_letters_of(spark, sf_dir)).groupBy("mode", "country").agg(F.count("*").alias("secrets"))


@query(f"select i as doc_id, true as ok from {_KEYS}")
def arena_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slot's place holds its value."""
    docs = _letters_of(spark, sf_dir)
    held = F.forall("slots", lambda s: F.substring(F.col("original"), s["start"] + 1, s["end"] - s["start"]) == s["value"])
    return docs.select("doc_id", held.alias("ok"))


def _arena_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = written(_letters_of(spark, sf_dir).withColumn("seg_no", F.lit(0).cast("long")), "arena")
    return docs, mapping.anonymize(dealt(docs.select("doc_id", "seg_no", "text"), "doc_id", LETTERS))[0]


@query(f"select mode, count(*)::bigint as documents, 0::bigint as leaks from (select case (i // 6) % 4 when 0 then 'clean' when 1 then 'reflow' when 2 then 'spacing' else 'list' end as mode from {_KEYS}) where mode in ('clean', 'list') group by mode")
def arena_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and leaks by mode, of the modes that keep values whole."""
    docs, out = _arena_run(spark, sf_dir)
    leaked = scoring.leaks(out, arena.secrets(docs)).groupBy("doc_id").agg(F.count("*").alias("n"))
    both = docs.filter(F.col("mode").isin("clean", "list")).join(leaked, "doc_id", "left")
    return both.groupBy("mode").agg(F.count("*").alias("documents"), F.sum(F.coalesce("n", F.lit(0))).alias("leaks"))


@query(f"select sum(case i % 6 when 4 then 3 else 4 end)::bigint as secrets, sum(case i % 6 when 4 then 3 else 4 end)::bigint as seen, true as ok from {_KEYS}")
def arena_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leak check sees every secret in the texts before they are anonymised."""
    docs = _letters_of(spark, sf_dir)
    return scoring.negative_control(docs.select("doc_id", "original"), arena.secrets(docs), "original")
