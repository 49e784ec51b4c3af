"""Recognisers, span algebra, mapping, audit log, permutation, scoring and the gate."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskwerk.operators import audit, mapping, permute, recognizers, scoring
from maskwerk.operators import spans as S
from maskwerk.plans import queries
from maskwerk.streaming import folder

CASES = [
    ("IBAN AT61 1904 3002 3457 3201.", [("IBAN", "AT61 1904 3002 3457 3201")]),
    ("AT61 1904 3002 3457 3202", []),
    ("DEUTSCHLAND hat BIC: GIBAATWWXXX", [("BIC", "GIBAATWWXXX")]),
    ("SVNR 1237 010180", [("SVNR", "1237 010180")]),
    ("St.-Nr. 12 345/6789-1", [("STEUERNR", "12 345/6789-1")]),
    ("FN 123456a", [("FN", "FN 123456a")]),
    ("gisa-zahl: 12345678, DVR 1234567, EZ 123, KG 12345", [("GISA", "gisa-zahl: 12345678"), ("DVR", "DVR 1234567"), ("GRUNDBUCH", "EZ 123"), ("GRUNDBUCH", "KG 12345")]),
    ("BLZ: 12345 Kontonr. 1234567", [("BLZ", "BLZ: 12345"), ("KONTO", "Kontonr. 1234567")]),
    ("Id 65 929 970 489", [("TAX_ID", "65 929 970 489")]),
    ("DE136695976", [("UID", "DE136695976")]),
    ("756.9217.0769.85", [("AHV", "756.9217.0769.85")]),
    ("Karte 4111-1111-1111-1111.", [("CREDITCARD", "4111-1111-1111-1111")]),
    ("an max.m@firma.co.at,", [("EMAIL", "max.m@firma.co.at")]),
    ("Tel +43 664 123-4567 oder 0664/123 45 67", [("PHONE", "+43 664 123-4567"), ("PHONE", "0664/123 45 67")]),
    ("(https://a.example/x?y=1). www.b.example!", [("URL", "https://a.example/x?y=1"), ("URL", "www.b.example")]),
    ("Die Hofer Bau GmbH & Co. KG zahlt", [("COMPANY", "Hofer Bau GmbH & Co. KG")]),
    ("Geburtsdatum: 01.02.1980, geboren am\n1990-12-31", [("DATE", "01.02.1980"), ("DATE", "1990-12-31")]),
    ("Datum 01.02.1980", []),
    ("Frau Dr. Eva von der Heide-Klein. Später: Eva von der Heide-Klein", [("PERSON", "Eva von der Heide-Klein")] * 2),
    ("Mandant: Ömer Öz", [("PERSON", "Ömer Öz")]),
    ("gestern Anna Huber da", [("PERSON", "Anna Huber")]),
    ("Anna\nHuber", []),
    ("Hauptstraße 12a/3, 1010 Wien", [("ADDRESS", "Hauptstraße 12a/3, 1010 Wien")]),
    ("<IBAN_001> bleibt", [("ESCAPED", "<IBAN_001>")]),
    ("sk-" + "a1" * 15, [("SECRET", "sk-" + "a1" * 15)]),
    ("😀 Herr Max Groß 😀", [("PERSON", "Max Groß")]),
    ("Audi A4, Werk Nord, keine Daten", []),
]


def test_recognizers(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string").select("i", "t", recognizers.detect(F.col("t")).alias("s")).collect()
    for r in sorted(rows):
        assert [(s["category"], s["text"]) for s in r["s"]] == CASES[r["i"]][1], r["t"]
        assert all(r["t"][s["start"] : s["end"]] == s["text"] for s in r["s"])


def test_recognizers_never_fail(spark):
    rng = random.Random(3)
    alphabet = "aZ09 .,@:/-+<>_äß€😀\n\t()ATUDEIBAN"
    rows = [("".join(rng.choices(alphabet, k=rng.randint(0, 200))),) for _ in range(60)] + [(None,), ("",), ("9" * 3000,), ("a@" * 1500,)]
    for r in spark.createDataFrame(rows, "t string").select("t", recognizers.detect(F.col("t")).alias("s")).collect():
        ends = [0]
        for s in r["s"]:
            assert s["start"] >= ends[-1] and r["t"][s["start"] : s["end"]] == s["text"]
            ends.append(s["end"])


def test_optional_recognizers(spark):
    some = [recognizers.terms(["Projekt X", "x"]), recognizers.user_pattern(r"M-(?P<n>\d+)"), recognizers.detector("model", lambda t: t.map(lambda x: [{"start": 0, "end": 2, "label": "per", "score": 0.9}, {"start": 0, "end": 1, "label": "?", "score": 1.0}]), {"per": "PERSON"})]
    r = spark.createDataFrame([("Xy projekt x M-77",)], "t string").select(recognizers.detect(F.col("t"), some)).first()[0]
    assert [(s["category"], s["text"]) for s in r] == [("PERSON", "Xy"), ("BEGRIFF", "projekt x"), ("MANDANT_NR", "M-77")]
    strict = spark.createDataFrame([("AT61 1904 3002 3457 3201 BIC GIBAATWW",)], "t string").select(recognizers.detect(F.col("t"), recognizers.bundle(strict=True))).first()[0]
    assert [s["category"] for s in strict] == ["IBAN", "BIC"]


def resolved(spans):
    out = []
    for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1], -s[2], s[3])):
        if out and s[0] < out[-1][1]:
            if (s[1] - s[0], s[2]) > (out[-1][1] - out[-1][0], out[-1][2]):
                out[-1] = s
        else:
            out.append(s)
    return out


def test_overlaps(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        spans = []
        for k in range(rng.randint(0, 8)):
            start = rng.randrange(20)
            spans.append((start, start + rng.randint(1, 8), "A", f"{k}", rng.choice([0.5, 0.9]), k))
        rows.append((i, spans))
    got = spark.createDataFrame(rows, f"i int, s array<{S.SPAN}>").select("i", S.resolve(F.col("s")).alias("r")).collect()
    assert {r["i"]: [(s["start"], s["end"], s["score"], s["ord"]) for s in r["r"]] for r in got} == {i: resolved([(a, b, p, k) for a, b, _, _, p, k in s]) for i, s in rows}


def segments(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, seg_no long, text string")


def test_numbering_and_roundtrip(spark):
    texts = ["b@x.at a@x.at", "c@x.at b@x.at", None, "", "nichts"] + [f"n{i}@x.at" for i in range(1010)]
    out, table = mapping.anonymize(segments(spark, texts), recognizers=[r for r in recognizers.bundle() if r.name == "email"])
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["anonymized"] for i in range(5)] == ["<EMAIL_002> <EMAIL_001>", "<EMAIL_003> <EMAIL_002>", None, "", "nichts"]
    assert got[1014]["anonymized"] == "<EMAIL_1013>" and got[0]["entity_counts"] == {"EMAIL": 2}
    assert {r["placeholder"]: r["use_count"] for r in table.collect()}["<EMAIL_002>"] == 2
    back = {r["doc_id"]: r for r in mapping.deanonymize(out.select("doc_id", "seg_no", "anonymized"), table.filter("placeholder != '<EMAIL_001>'")).collect()}
    assert back[0]["restored"] == "b@x.at <EMAIL_001>" and back[0]["missing"] == ["<EMAIL_001>"] and back[0]["resolved"] == ["<EMAIL_002>"] and back[2]["restored"] is None
    assert [tuple(r) for r in mapping.missing(out, table.filter("placeholder != '<EMAIL_001>'")).collect()] == [(0, "<EMAIL_001>")]


def test_merged_spellings_and_placeholders_in_texts_come_back(spark):
    texts = ["A.B@x.at, a.b@X.at a.b@x.at", "a.b@x.at <EMAIL_001> <IBAN_007>", None, "", "<EMAIL_001>", "\U0001f600 c-d@x.at<EMAIL_002>c+d@x.at"]
    out, table = mapping.anonymize(segments(spark, texts), recognizers=[r for r in recognizers.bundle() if r.name == "email"])
    assert table.count() == 2
    got = {r["doc_id"]: r for r in mapping.deanonymize(out.select("doc_id", "seg_no", "anonymized", "spelled"), table).collect()}
    assert [got[i]["restored"] for i in range(6)] == texts and not any(r["missing"] for r in got.values())
    assert [len(got[i]["resolved"]) for i in range(6)] == [3, 1, 0, 0, 0, 2] and got[1]["entity_counts"] == {"EMAIL": 1}
    plain = {r["doc_id"]: r for r in mapping.deanonymize(out.select("doc_id", "seg_no", "anonymized"), table).collect()}
    assert plain[0]["restored"] == "a.b@x.at, a.b@x.at a.b@x.at" and plain[1]["missing"] == ["<IBAN_007>"]


def test_roundtrip_query_of_merged_and_missing_texts(spark, tmp_path):
    rows = [(1, "An A.B@x.at"), (2, "an a.b@x.at"), (3, None), (4, "Muster <EMAIL_001> und <FN_004>")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.deanonymize_roundtrip(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, True, 0) for i in range(1, 5)]


def test_letters_are_many_tasks(spark, tmp_path):
    """However small the file of customers is: each makes a letter in which all recognisers look."""
    spark.range(9000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    parts = [r["count"] for r in queries.letters(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 9000 and max(parts) < 1.2 * queries.LETTERS


def test_existing_mappings_win_and_companies_merge(spark):
    first, table = mapping.anonymize(segments(spark, ["Musterhandel Wien GmbH zahlt", "Hofer AG"]))
    table = spark.createDataFrame(table.collect(), mapping.MAPPING)
    more = ["musterhandel  x", "Die Musterhandel Wienn GmbH", "Hofer KG und Hofer AG", "Neuer Betrieb Graz OG"]
    out, after = mapping.anonymize(segments(spark, more), table)
    got = [r["anonymized"] for r in sorted(out.collect())]
    assert got[1] == "Die <COMPANY_001>" and got[2] == "<COMPANY_003> und <COMPANY_002>" and got[3] == "<COMPANY_004>"
    uses = {r["placeholder"]: (r["original"], r["use_count"]) for r in after.collect()}
    assert uses["<COMPANY_001>"] == ("Musterhandel Wien GmbH", 2) and uses["<COMPANY_002>"] == ("Hofer AG", 2) and len(uses) == 4


def test_greedy_merge_is_ordered_and_not_transitive(spark):
    names = ["aaaaaaaaaaaa gmbh", "aaaaaaaaaaab gmbh", "aaaaaaaaaabb gmbh", "aaaaaaaaaacb gmbh"]
    keys = spark.createDataFrame([("COMPANY", n, (i, 0, 0), n, 1) for i, n in enumerate(names)], "category string, normal string, at struct<doc_id:long,seg_no:long,back:int>, original string, use_count long")
    got = {r["normal"]: r["into"] for r in mapping.merged(keys).collect()}
    assert got == {names[0]: names[0], names[1]: names[0], names[2]: names[2], names[3]: names[2]}


def test_same_placeholders_for_any_partitioning(spark):
    rng = random.Random(5)
    texts = [" ".join(f"u{rng.randrange(50)}@x.at" for _ in range(rng.randint(0, 4))) for _ in range(120)]
    some = [r for r in recognizers.bundle() if r.name == "email"]
    tables = [sorted(map(tuple, mapping.anonymize(segments(spark, texts).repartition(n), recognizers=some)[1].collect())) for n in (1, 7)]
    assert tables[0] == tables[1] and len(tables[0]) == len({w for t in texts for w in t.split()})


def test_store_keeps_no_plain_text(spark, tmp_path):
    store = mapping.Store(spark, str(tmp_path / "m"), b"k" * 32, b"digest")
    assert store.load() is None
    table = spark.createDataFrame([("<EMAIL_001>", "EMAIL", "a x.at", "a@x.at", 1)], mapping.MAPPING)
    store.save(table)
    store.save(table.withColumn("use_count", F.lit(2).cast("long")))
    assert [tuple(r) for r in store.load().collect()] == [("<EMAIL_001>", "EMAIL", "a x.at", "a@x.at", 2)]
    raw = spark.read.parquet(str(next((tmp_path / "m").glob("0*"))))
    assert mapping.lookup(raw, "A@x.at", "EMAIL", b"digest").count() == 1
    assert not any(b"x.at" in p.read_bytes() for p in (tmp_path / "m").rglob("*.parquet"))


def events(spark, n):
    return spark.createDataFrame([(i, f"2026-01-01T00:00:{i:02d}", "anonymize", '{"A":1}', "0" * 64, "n/a", "1") for i in range(n)], "seq long, " + ", ".join(f"{c} string" for c in audit.FIELDS[:-1]))


def test_audit_chain(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(audit, "RANGE", 4)
    log = spark.createDataFrame(audit.append(events(spark, 11)).collect(), audit.LOG)
    longer = log.union(spark.createDataFrame(audit.append(events(spark, 5), log).collect(), audit.LOG))
    assert audit.tail(longer)[0] == 16 and audit.verify(longer) and audit.verify(log.limit(0))
    assert [r["id"] for r in audit.entries(longer).collect()] == list(range(1, 17))
    for column in audit.FIELDS:
        assert not audit.verify(longer.withColumn(column, F.when(F.col("id") == 9, F.lit("x")).otherwise(F.col(column))))
    assert not audit.verify(longer.filter("id != 5"))
    audit.export_csv(longer, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 16


def test_permutation(spark):
    rows = spark.createDataFrame([(i, float(i * i) if i % 7 else None) for i in range(200)], "id long, v double")
    key = permute.key_from_secret(b"s")
    moved = permute.spread(rows, "id", "v", key, parts=5).collect()
    assert Counter(r["v"] for r in moved) == Counter(r["v"] for r in rows.collect()) and all((r["v"] is None) == (r["id"] % 7 == 0) for r in moved)
    assert sum(r["v"] != r["id"] ** 2 for r in moved) > 120
    assert sorted(moved) == sorted(permute.spread(rows.repartition(9), "id", "v", key, parts=5).collect())
    cells = permute.exact(permute.long_form(rows, "id", "s"), key).orderBy("row").collect()
    assert [r["value"] for r in cells] == permute.shuffled([float(i * i) if i % 7 else None for i in range(200)], permute.seed_for(key, "s", "v"))
    assert tuple(permute.stats(rows.limit(0), "v").first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert permute.shuffled([None, 3.0, None], 1) == [None, 3.0, None]


def test_scoring(spark):
    span = "doc_id long, category string, start int, end int"
    expected = spark.createDataFrame([(1, "A", 0, 10), (1, "A", 20, 30), (1, "B", 0, 5), (2, "C", 0, 4)], span)
    found = spark.createDataFrame([(1, "A", 0, 9), (1, "A", 1, 10), (1, "B", 3, 9), (3, "A", 0, 2)], span)
    got = {(r["doc_id"], r["category"]): (r["tp"], r["fp"], r["fn"]) for r in scoring.matched(expected, found).collect()}
    assert got == {(1, "A"): (1, 1, 1), (1, "B"): (0, 1, 1), (2, "C"): (0, 0, 1), (3, "A"): (0, 1, 0)}
    report = {r["category"]: (r["precision"], r["recall"], r["f1"]) for r in scoring.report(scoring.matched(expected, found)).collect()}
    assert report == {"A": (0.3333, 0.5, 0.4), "B": (0.0, 0.0, 0.0), "C": (1.0, 0.0, 0.0), None: (0.25, 0.25, 0.25)}


def test_leaks_and_gates(spark):
    secrets = spark.createDataFrame([(1, "IBAN", "AT61 1904"), (1, "PERSON", "Max Muster"), (2, "PERSON", "Eva Klein")], "doc_id long, category string, value string")
    texts = spark.createDataFrame([(1, "x at611904 y <PERSON_001>"), (2, "eva\n klein")], "doc_id long, anonymized string")
    assert {tuple(r)[:2] for r in scoring.leaks(texts, secrets).collect()} == {(1, "IBAN"), (2, "PERSON")}
    files = spark.createDataFrame([("a", "Netz und netz"), ("b", "nichts")], "path string, text string")
    assert {tuple(r) for r in scoring.coverage(spark.createDataFrame([("NETZ",), ("xyz",)], "keyword string"), files).collect()} == {("NETZ", 1), ("xyz", 0)}
    out = spark.createDataFrame([(1, "alles <UID_001>", []), (2, "noch da: a@b.at", [])], f"doc_id long, anonymized string, spans array<{S.SPAN}>")
    assert [(r["passed"], r["no_hits"]) for r in folder.gated(out).orderBy("doc_id").collect()] == [(True, True), (False, True)]


@pytest.mark.parametrize("n", [1, 5])
def test_rate_limit(spark, n):
    rows = [(f"c{k}", float(t)) for k in range(n) for t in (0, 0, 0, 1, 100)]
    got = folder.allowed(spark.createDataFrame(rows, "client string, at double"), burst=2, rate=1.0).orderBy("client", "at").collect()
    assert [r["allowed"] for r in got[:5]].count(False) == 1 and len(got) == 5 * n


@pytest.mark.parametrize("few", [0, 1000])
def test_components_in_rounds_and_in_one_task(spark, few):
    from maskwerk.operators import graph

    rng = random.Random(few)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(5, 5)]
    label = {n: n for p in pairs for n in p if p[0] != p[1]}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in pairs:
        if a != b:
            label[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "u long, v long"), few).collect()}
    assert got == {n: root(n) for n in label}
    assert graph.components(spark.createDataFrame([], "u long, v long"), few).count() == 0
