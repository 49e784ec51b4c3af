"""Queries over the test tables for the engine's operators, and the same in DuckDB's SQL.

The tables hold few of the identifiers that the engine looks for, so some queries build them from integer
keys, with the same arithmetic in both dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwerk.functions import checksums as C
from maskwerk.functions import text as X
from maskwerk.operators import audit, mapping, permute, recognizers, scoring
from maskwerk.operators import spans as S
from maskwerk.plans.tables import dealt, written
from maskwerk.sources import files
from maskwerk.streaming import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(*names: str) -> list[recognizers.Recognizer]:
    return [r for r in recognizers.bundle() if r.name in names]


def segments(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("seg_no"), "text")


# ---------------------------------------------------------------- checksums over made-up identifiers

KEY = "c_custkey"


def _made(spark: SparkSession, sf_dir: str, expression: str, check) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col(KEY).cast("long").alias("key"), F.expr(expression).alias("candidate"))
    return rows.select("key", "candidate", check(F.col("candidate")).alias("valid"))


_ISO = "(11 - list_reduce(list_transform(string_split({d}, ''), lambda x: x::int), lambda p, x: (case when (p + x) % 10 = 0 then 10 else (p + x) % 10 end) * 2 % 11, 10)) % 10"


@query(f"""select c_custkey::bigint as key, candidate, (98 - (candidate[5:] || '102900')::hugeint % 97) = candidate[3:4]::int as valid from (
    select c_custkey, 'AT' || lpad((case when c_custkey % 2 = 0 then (98 - (b || '102900')::hugeint % 97) else c_custkey % 97 + 2 end)::varchar, 2, '0') || b as candidate
    from (select c_custkey, lpad((c_custkey * 31 % 100000)::varchar, 5, '0') || lpad((c_custkey * 7919 % 100000000000)::varchar, 11, '0') as b from customer))""")
def iban_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = f"concat(lpad(cast({KEY} * 31 % 100000 as string), 5, '0'), lpad(cast({KEY} * 7919 % 100000000000 as string), 11, '0'))"
    digits = f"case when {KEY} % 2 = 0 then 98 - cast(concat({b}, '102900') as decimal(38,0)) % 97 else {KEY} % 97 + 2 end"
    return _made(spark, sf_dir, f"concat('AT', lpad(cast(cast({digits} as int) as string), 2, '0'), {b})", C.valid_iban)


@query("""select key, candidate, (10 - (d(4) + x(5) + d(6) + x(7) + d(8) + x(9) + d(10) + 4) % 10) % 10 = d(11) as valid from
    (select c_custkey::bigint as key, 'ATU' || lpad((c_custkey * 48271 % 100000000)::varchar, 8, '0') as candidate from customer)"""
    .replace("d(10)", "candidate[10]::int").replace("d(11)", "candidate[11]::int").replace("d(4)", "candidate[4]::int").replace("d(6)", "candidate[6]::int").replace("d(8)", "candidate[8]::int")
    .replace("x(5)", "(candidate[5]::int * 2 // 10 + candidate[5]::int * 2 % 10)").replace("x(7)", "(candidate[7]::int * 2 // 10 + candidate[7]::int * 2 % 10)").replace("x(9)", "(candidate[9]::int * 2 // 10 + candidate[9]::int * 2 % 10)"))
def at_uid_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, f"concat('ATU', lpad(cast({KEY} * 48271 % 100000000 as string), 8, '0'))", C.valid_at_uid)


@query("""select key, candidate, candidate[5:6]::int between 1 and 31 and candidate[7:8]::int between 1 and 12
    and list_sum(list_transform([[1,3],[2,7],[3,9],[5,5],[6,8],[7,4],[8,2],[9,1],[10,6]], lambda w: candidate[w[1]]::int * w[2]))::bigint % 11 = candidate[4]::int as valid from
    (select c_custkey::bigint as key, lpad((c_custkey * 37 % 10000)::varchar, 4, '0') || lpad((c_custkey % 33)::varchar, 2, '0') || lpad((c_custkey % 13)::varchar, 2, '0') || lpad((c_custkey % 100)::varchar, 2, '0') as candidate from customer)""")
def svnr_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = lambda e, n: f"lpad(cast({e} as string), {n}, '0')"
    return _made(spark, sf_dir, f"concat({pad(f'{KEY} * 37 % 10000', 4)}, {pad(f'{KEY} % 33', 2)}, {pad(f'{KEY} % 13', 2)}, {pad(f'{KEY} % 100', 2)})", C.valid_svnr)


@query(f"select key, candidate, {_ISO.format(d='candidate[3:10]')} = candidate[11]::int as valid from (select c_custkey::bigint as key, 'DE' || lpad((c_custkey * 69621 % 1000000000)::varchar, 9, '0') as candidate from customer)")
def de_uid_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, f"concat('DE', lpad(cast({KEY} * 69621 % 1000000000 as string), 9, '0'))", C.valid_de_uid)


_ROT = "substring('01234567890123456789', {k} % 10 + 1, 9)"


@query(f"""select key, candidate, {_ISO.format(d='candidate[1:10]')} = candidate[11]::int and case when len(distincts) = 9 then most = 2 when len(distincts) = 8 then most = 3 else false end as valid from (
    select *, list_distinct(string_split(candidate[1:10], '')) as distincts, list_max(list_transform(string_split(candidate[1:10], ''), lambda x: len(list_filter(string_split(candidate[1:10], ''), lambda y: y = x)))) as most from (
    select c_custkey::bigint as key, {_ROT.format(k='c_custkey')} || case when c_custkey % 7 = 0 then '5' else substring({_ROT.format(k='c_custkey')}, 1, 1) end || (c_custkey // 10 % 10)::varchar as candidate from customer))""")
def de_tax_id_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rot = _ROT.format(k=KEY)
    return _made(spark, sf_dir, f"concat({rot}, case when {KEY} % 7 = 0 then '5' else substring({rot}, 1, 1) end, cast({KEY} div 10 % 10 as string))", C.valid_de_tax_id)


@query("""select key, candidate, (10 - list_sum(list_transform(range(1, 13), lambda i: candidate[i]::int * case when i % 2 = 1 then 1 else 3 end))::bigint % 10) % 10 = candidate[13]::int as valid
    from (select c_custkey::bigint as key, '756' || lpad((c_custkey * 630360016 % 10000000000)::varchar, 10, '0') as candidate from customer)""")
def ahv_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, f"concat('756', lpad(cast({KEY} * 630360016 % 10000000000 as string), 10, '0'))", C.valid_ahv)


@query("""select key, candidate, list_sum(list_transform(range(0, 16), lambda i: case when i % 2 = 1 then candidate[16 - i]::int * 2 // 10 + candidate[16 - i]::int * 2 % 10 else candidate[16 - i]::int end))::bigint % 10 = 0 as valid
    from (select c_custkey::bigint as key, '4' || lpad((c_custkey * 742938285 % 1000000000000000)::varchar, 15, '0') as candidate from customer)""")
def card_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, f"concat('4', lpad(cast({KEY} * 742938285 % 1000000000000000 as string), 15, '0'))", C.valid_card)


# ---------------------------------------------------------------- recognisers

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_MAILS = f"(select doc_id, text, regexp_extract_all(text, '{_EMAIL}') as m from documents)"


@query(f"select doc_id, len(m)::bigint as n_emails from {_MAILS} where len(m) > 0")
def email_spans_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.size(recognizers.detect(F.col("text"), only("email"))).cast("long").alias("n_emails"))
    return found.filter("n_emails > 0")


@query(f"select lower(regexp_replace(e, '^.*@', '')) as domain, count(*) as n from (select unnest(m) as e from {_MAILS}) group by 1 order by n desc, domain limit 10")
def email_top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.explode(recognizers.detect(F.col("text"), only("email"))).alias("s"))
    domains = found.groupBy(F.lower(F.substring_index("s.text", "@", -1)).alias("domain")).agg(F.count("*").alias("n"))
    return domains.orderBy(F.desc("n"), "domain").limit(10)


@query("""select s_suppkey::bigint as key, case when s_suppkey % 3 = 0 then 0 when s_suppkey % 5 = 0 then 0 else 1 end::bigint as n_bic from supplier""")
def bic_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third without a keyword before the code, a fifth with a country that does not exist."""
    text = F.expr("concat('Bank ', case when s_suppkey % 3 = 0 then 'Ort' when s_suppkey % 2 = 0 then 'Swift-Code' else 'BIC' end, ': GIBA', case when s_suppkey % 5 = 0 then 'XX' else 'AT' end, 'WW', case when s_suppkey % 4 = 0 then 'XXX' else '' end, ' Ende')")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), text.alias("text"))
    return rows.select("key", F.size(recognizers.detect(F.col("text"), only("bic"))).cast("long").alias("n_bic"))


#: A letter for each customer; which parts it has depends on the key.
LETTER = """concat('Herr Max Muster', case when c_custkey % 2 = 0 then 'mann' else 'frau' end, ' schreibt: ',
    case when c_custkey % 3 = 0 then concat('Die Huber ', substring('BauHolzGlas', c_custkey % 2 * 3 + 1, 3), ' GmbH & Co. KG liefert. ') else '' end,
    case when c_custkey % 4 = 0 then concat('Hauptstraße ', cast(c_custkey % 90 + 1 as string), 'a, 1', lpad(cast(c_custkey % 1000 as string), 3, '0'), ' Wien. ') else '' end,
    case when c_custkey % 5 = 0 then 'Tel. +43 664 1234567. ' else '' end, case when c_custkey % 6 = 0 then 'geboren am 01.02.1980. ' else '' end,
    case when c_custkey % 7 = 0 then 'Siehe https://www.example.at/a?b=c, ' else '' end, case when c_custkey % 9 = 0 then 'FN 123456a, St.-Nr. 12 345/6789. ' else '' end,
    case when c_custkey % 10 = 0 then 'BLZ: 12345 Kontonummer 1234567. ' else '' end, case when c_custkey % 11 = 0 then 'GISA-Zahl: 12345678. ' else '' end,
    case when c_custkey % 13 = 0 then '<IBAN_001> ' else '' end, 'Es grüßt Anna von der Leyen.')"""


#: Letters of one task: a second or some of detection.
LETTERS = 4000


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters, dealt out by their keys: a file of millions of customers is small enough for a single task."""
    return dealt(table(spark, sf_dir, "customer").select(KEY), KEY, LETTERS).select(F.col(KEY).cast("long").alias("doc_id"), F.expr(LETTER).alias("text"))


_EXPECTED = " union all ".join(
    f"select c_custkey::bigint as doc_id, '{category}' as category, {n}::bigint as n from customer where c_custkey % {m} = 0"
    for category, m, n in (("PERSON", 1, 2), ("COMPANY", 3, 1), ("ADDRESS", 4, 1), ("PHONE", 5, 1), ("DATE", 6, 1), ("URL", 7, 1), ("FN", 9, 1), ("STEUERNR", 9, 1), ("BLZ", 10, 1), ("KONTO", 10, 1), ("GISA", 11, 1), ("ESCAPED", 13, 1))
)


@query(f"select * from ({_EXPECTED})")
def detect_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by letter and category, of all recognisers, overlaps resolved."""
    found = letters(spark, sf_dir).select("doc_id", F.explode(recognizers.detect(F.col("text"))).alias("s"))
    return found.groupBy("doc_id", F.col("s.category").alias("category")).agg(F.count("*").alias("n"))


@query()
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recognisers over all documents: spans by category."""
    found = table(spark, sf_dir, "documents").select(F.explode(recognizers.detect(F.col("text"))).alias("s"))
    return found.groupBy(F.col("s.category").alias("category")).agg(F.count("*").alias("n"))


@query()
def card_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.size(recognizers.detect(F.col("text"), only("card"))).cast("long").alias("n_cards"))
    return found.filter("n_cards > 0")


@query("""select role, count(*) as turns, sum(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')))::bigint as n_emails from conversations group by role""")
def conversations_pii_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("role", F.size(recognizers.detect(F.col("text"), only("email"))).cast("long").alias("n"))
    return rows.groupBy("role").agg(F.count("*").alias("turns"), F.sum("n").alias("n_emails"))


@query("select page_id, len(regexp_replace(html, 'data:[A-Za-z0-9.+/-]+;base64,[A-Za-z0-9+/=\\s]+', 'data:removed', 'g'))::bigint as n_chars from pages")
def html_without_data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(files.without_data_uris(F.col("html"))).cast("long").alias("n_chars"))


@query("""select split_part(split_part(url, '://', 2), '/', 1) as host, count(*) as n from pages group by 1""")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of the URLs that the recogniser finds in the pages' addresses."""
    found = table(spark, sf_dir, "pages").select(F.explode(recognizers.detect(F.col("url"), only("url"))).alias("s"))
    return found.groupBy(F.substring_index(F.substring_index("s.text", "://", -1), "/", 1).alias("host")).agg(F.count("*").alias("n"))


@query("""select p_partkey::bigint as key, (case when contains(lower(p_name), 'a') then 1 else 0 end + case when contains(lower(p_type), 'steel') then 1 else 0 end)::bigint as n from part""")
def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom terms in any case; a text counts once for each term it holds."""
    has = lambda c, t: F.size(recognizers.terms([t]).find(F.col(c), 0)) > 0
    a = F.col("p_name").rlike("(?i)a").cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("key"), (a + has("p_type", "Steel").cast("long")).alias("n"))


@query("""select quality::bigint as quality, count(*) as docs, sum(case when regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') then 1 else 0 end)::bigint as with_email from documents join labels using (doc_id) group by 1""")
def docs_quality_pii_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.size(recognizers.detect(F.col("text"), only("email"))) > 0).cast("long").alias("hit"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("quality").cast("long").alias("quality")).agg(F.count("*").alias("docs"), F.sum("hit").alias("with_email"))


# ---------------------------------------------------------------- normal forms and merging

@query("""select c_custkey::bigint as key, trim(regexp_replace(regexp_replace(replace(replace(lower('Ärger & Söhne ' || c_name || ' (é)'), 'ä', 'ae'), 'ö', 'oe'), '[^a-z0-9_&. é]', ' ', 'g'), ' +', ' ', 'g')).replace('é', 'e') as normal from customer""")
def normalize_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col(KEY).cast("long").alias("key"), X.normalize(F.concat(F.lit("Ärger & Söhne "), F.col("c_name"), F.lit(" (é)"))).alias("normal"))


@query("""select s_suppkey::bigint as key, case when s_suppkey % 4 = 0 then true when s_suppkey % 4 = 1 then true when s_suppkey % 4 = 2 then false else false end as same from supplier""")
def merge_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edit and punctuation merge; another legal form and two edits do not."""
    other = F.expr("concat('musterhandel', case s_suppkey % 4 when 0 then 's' when 1 then ' .' when 3 then 'xyz' else '' end, ' ', lpad(cast(s_suppkey as string), 6, '0'), case when s_suppkey % 4 = 2 then ' ag' else ' gmbh' end)")
    own = F.expr("concat('musterhandel ', lpad(cast(s_suppkey as string), 6, '0'), ' gmbh')")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), X.should_merge(own, other, F.lit("COMPANY")).alias("same"))


_CODES = f"""mails as (select doc_id, unnest(m) as e, unnest(range(len(m))) as i from {_MAILS}),
normal as (select *, trim(regexp_replace(regexp_replace(lower(e), '[^a-z0-9_&. ]', ' ', 'g'), ' +', ' ', 'g')) as n from mails),
firsts as (select n, min((doc_id, -i)) as first_at, arg_min(e, (doc_id, -i)) as original, count(*) as use_count from normal group by n),
codes as (select n, original, use_count, '<EMAIL_' || lpad(k::varchar, greatest(3, len(k::varchar))::int, '0') || '>' as placeholder from (select *, row_number() over (order by first_at) as k from firsts))"""


def _email_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = segments(table(spark, sf_dir, "documents"))
    out, codes = mapping.anonymize(docs, recognizers=only("email"))
    return out, codes


@query(f"with {_CODES} select placeholder, n as normal, original, use_count from codes")
def encode_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _email_texts(spark, sf_dir)[1].drop("category")


@query(f"""with {_CODES}, per as (select doc_id, list({{'e': e, 'p': placeholder}} order by len(e) desc, e) as l from (select distinct doc_id, e, placeholder from normal join codes using (n)) group by doc_id)
select d.doc_id, case when l is null then text else list_reduce(list_transform(l, lambda x: {{'e': x.e, 'p': x.p, 't': null::varchar}}), lambda a, x: {{'e': x.e, 'p': x.p, 't': replace(a.t, x.e, x.p)}}, {{'e': '', 'p': '', 't': text}}).t end as anonymized from documents d left join per using (doc_id)""")
def anonymize_email_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _email_texts(spark, sf_dir)[0].select("doc_id", "anonymized")


@query("select doc_id, true as same, 0::bigint as n_missing from documents")
def deanonymize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restored texts against the originals, spellings that were merged included; a missing text (null) stays one."""
    out, codes = _email_texts(spark, sf_dir)
    back = mapping.deanonymize(out.select("doc_id", "seg_no", "text", "anonymized", "spelled"), codes)
    return back.select("doc_id", F.col("restored").eqNullSafe(F.col("text")).alias("same"), F.size("missing").cast("long").alias("n_missing"))


@query(f"with {_CODES} select distinct doc_id, placeholder from normal join codes using (n) where substr(placeholder, 8, len(placeholder) - 8)::int % 3 = 0")
def missing_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders without a mapping, when every third one is gone."""
    out, codes = _email_texts(spark, sf_dir)
    left = codes.filter(F.regexp_extract("placeholder", "_([0-9]+)>", 1).cast("int") % 3 != 0)
    return mapping.missing(out, left)


@query("select c_custkey::bigint as doc_id, true as same from customer")
def letters_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters anonymised with all recognisers and restored, up to spellings that were merged."""
    out, codes = mapping.anonymize(segments(letters(spark, sf_dir)))
    back = mapping.deanonymize(out.select("doc_id", "seg_no", "text", "anonymized"), codes)
    return back.select("doc_id", (F.col("restored") == F.col("text")).alias("same"))


@query("select c_custkey::bigint // 2000 as doc_id, count(*)::bigint as uids, true as same from customer group by 1")
def uid_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of 2,000 lines with a customer's valid VAT id each, anonymised and restored: the published workload, for each 2,000 customers."""
    rows = table(spark, sf_dir, "customer").select(F.col(KEY).cast("long").alias("id"))
    digits = F.lpad(((F.col("id") * 4999 + 1_000_000) % 10_000_000).cast("string"), 7, "0")
    total = sum((F.substring(digits, i, 1).cast("int") if i % 2 else F.floor(F.substring(digits, i, 1).cast("int") * 2 / 10).cast("int") + F.substring(digits, i, 1).cast("int") * 2 % 10 for i in range(1, 8)), F.lit(0))
    line = F.concat(F.lit("Zeile "), F.col("id").cast("string"), F.lit(" UID ATU"), digits, ((10 - (total + 4) % 10) % 10).cast("string"))
    lines = rows.groupBy(F.expr("id div 2000").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("x"))
    text = lines.select("doc_id", F.array_join(F.col("x.line"), "\n").alias("text"))
    out, codes = mapping.anonymize(segments(text))
    back = mapping.deanonymize(out.select("doc_id", "seg_no", "text", "anonymized"), codes)
    return back.select("doc_id", F.size("resolved").cast("long").alias("uids"), (F.col("restored") == F.col("text")).alias("same"))


@query()
def residual_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mapping.anonymize(segments(letters(spark, sf_dir)))
    return folder.gated(out).select("doc_id", "residual", "passed", "no_hits")


# ---------------------------------------------------------------- audit, permutation

_EVENT = "'2026-01-01T00:00:00+00:00' as ts, 'anonymize' as op, '{{\"EMAIL\":' || {n} || '}}' as counts, sha256({t}) as th, 'n/a' as mv, '1.0.0' as rv"


def _nation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("seq"), F.lit("2026-01-01T00:00:00+00:00").alias("timestamp_utc"), F.lit("anonymize").alias("operation"),
        X.counts_json(F.create_map(F.lit("EMAIL"), F.col("n_nationkey").cast("int"))).alias("entity_counts_json"), F.sha2("n_name", 256).alias("anonymized_text_sha256"),
        F.lit("n/a").alias("model_version"), F.lit("1.0.0").alias("recognizer_version"),
    )
    return audit.append(rows)


@query(f"""with recursive e as (select n_nationkey::bigint + 1 as id, {_EVENT.format(n='n_nationkey', t='n_name')} from nation),
chain as (select 0::bigint as id, repeat('0', 64) as h, '' as prev union all
    select e.id, sha256(concat_ws('|', ts, op, counts, th, mv, rv, chain.h)), chain.h from chain join e on e.id = chain.id + 1)
select id, prev as prev_hash, h as this_hash from chain where id > 0""")
def audit_chain_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_log(spark, sf_dir).select("id", "prev_hash", "this_hash")


@query("select n_nationkey::bigint + 1 as id, n_nationkey not in (7, 8) as ok from nation")
def audit_tamper_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry whose hash is forged to fit itself breaks the link behind it; one with other counts breaks itself."""
    log = written(_nation_log(spark, sf_dir), "log")
    counts = F.when(F.col("id") == 8, F.lit('{"EMAIL":99}')).otherwise(F.col("entity_counts_json"))
    forged = log.withColumn("entity_counts_json", counts)
    return audit.checked(forged.withColumn("this_hash", F.when(F.col("id") == 8, F.reverse("this_hash")).otherwise(F.col("this_hash"))))


@query("select count(*)::bigint as count, round(sum(o_totalprice), 2) as sum, min(o_totalprice) as min, max(o_totalprice) as max from orders")
def permute_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = permute.spread(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", permute.key_from_secret(b"test"))
    return permute.stats(moved, "o_totalprice").select("count", F.round("sum", 2).alias("sum"), "min", "max")


@query("select 'p_retailprice' as col, count(*)::bigint as n, round(sum(p_retailprice), 2) as sum from part union all select 'p_size', count(*)::bigint, round(sum(p_size)::double, 2) from part")
def permute_part_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every numeric column by the single-node generator; the key column stays."""
    cells = permute.long_form(table(spark, sf_dir, "part"), "p_partkey", "part")
    return permute.exact(cells, permute.key_from_secret(b"test")).groupBy("col").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("sum"))


# ---------------------------------------------------------------- quality

def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expected spans, one for each customer, and found ones: the same, shifted by a third, missing, and superfluous."""
    rows = table(spark, sf_dir, "customer").select(F.col(KEY).cast("long").alias("doc_id"), F.element_at(F.array(F.lit("IBAN"), F.lit("PERSON"), F.lit("DATE")), (F.col(KEY) % 3 + 1).cast("int")).alias("category"))
    expected = rows.withColumns({"start": F.lit(10), "end": F.lit(30)})
    k = F.col("doc_id") % 5
    shift = F.when(k == 1, 5).when(k == 2, 14).otherwise(0)
    found = rows.filter(k != 3).withColumns({"start": F.lit(10) + shift, "end": F.lit(30) + shift})
    return expected, found.union(rows.filter(k == 4).withColumns({"start": F.lit(50), "end": F.lit(60)}))


_COUNTS = """(select ['IBAN', 'PERSON', 'DATE'][c_custkey % 3 + 1] as category, case when c_custkey % 5 in (0, 1, 4) then 1 else 0 end as tp, case when c_custkey % 5 in (2, 4) then 1 else 0 end as fp,
    case when c_custkey % 5 in (2, 3) then 1 else 0 end as fn from customer)"""


@query(f"""select category, tp, fp, fn, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end, 4) as f1 from (
    select category, tp, fp, fn, case when tp + fp = 0 then 1.0 else tp / (tp + fp) end::double as p, case when tp + fn = 0 then 1.0 else tp / (tp + fn) end::double as r from (
    select category, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from {_COUNTS} group by rollup (category)))""")
def quality_prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.report(scoring.matched(*_spans(spark, sf_dir)))


@query(f"select category, sum(fp)::double / (sum(tp) + sum(fp)) as fp_rate from {_COUNTS} group by 1")
def fp_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.false_positive_rate(scoring.matched(*_spans(spark, sf_dir)))


@query("select 'AHV' as category, 1.0::double as least, 0::bigint as severity")
def gate_gaps_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([(1, "| Category | Least |"), (2, "| **IBAN** | >= 0.10 |"), (3, "| PERSON | ≥ 0,95 | x |"), (4, "| AHV | 1.00 |"), (5, "| IBAN | 1.00 |")], "n long, value string")
    scores = scoring.report(scoring.matched(*_spans(spark, sf_dir))).filter("category is not null")
    return scoring.gate_gaps(scoring.gate_rows(lines), scores).limit(1).select("category", "least", F.col("severity").cast("long").alias("severity"))


@query("""select mode, category, count(*) as secrets, sum(leak)::bigint as leaks, sum(leak)::double / count(*) as rate from (
    select case when c_custkey % 2 = 0 then 'clean' else 'spacing' end as mode, case when c_custkey % 3 = 0 then 'IBAN' else 'PERSON' end as category, case when c_custkey % 4 = 0 then 1 else 0 end as leak from customer) group by rollup (mode, category)""")
def leaks_by_mode_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets that are still in a text, spaced out or not, by mode and category."""
    rows = table(spark, sf_dir, "customer").select(
        F.col(KEY).cast("long").alias("doc_id"), F.expr(f"case when {KEY} % 2 = 0 then 'clean' else 'spacing' end").alias("mode"), F.expr(f"case when {KEY} % 3 = 0 then 'IBAN' else 'PERSON' end").alias("category"),
        F.expr(f"case when {KEY} % 3 = 0 then concat('AT61', lpad(cast({KEY} as string), 8, '0')) else concat('Max  Muster', cast({KEY} as string), 'x') end").alias("value"),
    )
    shown = F.when(F.col("category") == "IBAN", F.concat(F.substring("value", 1, 4), F.lit(" "), F.substring("value", 5, 99))).otherwise(F.regexp_replace("value", " +", "\n"))
    texts = rows.select("doc_id", F.concat(F.lit("Text: "), F.when(F.col("doc_id") % 4 == 0, shown).otherwise(F.lit("<X_001>")), F.lit(" end")).alias("anonymized"))
    return scoring.leak_rates(rows, scoring.leaks(texts, rows), "mode", "category")


@query("select sha256(string_agg(n_name || chr(0) || sha256(n_name) || chr(10), '' order by n_name)) as manifest from nation")
def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.manifest(table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256")))


@query("""select c_custkey::bigint as key, '=IF(A1="' || upper('x"" y') || '",' || c_custkey || ',"' || upper(c_mktsegment) || '")' as formula from customer""")
def formula_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change applied to the quoted operands of formulas."""
    formula = F.concat(F.lit('=IF(A1="x"" y",'), F.col(KEY), F.lit(',"'), F.lower("c_mktsegment"), F.lit('")'))
    return table(spark, sf_dir, "customer").select(F.col(KEY).cast("long").alias("key"), X.formula_texts(formula, F.upper).alias("formula"))


@query()
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-bucket decisions over the events of each user."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return folder.allowed(events.withColumn("client", F.col("client").cast("string")), burst=3, rate=0.001)
