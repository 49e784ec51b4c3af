"""Merging of near names in rounds against the plain greedy fold."""

import random

import pytest
from pyspark.sql import functions as F

from maskwerk.operators import mapping, merging

AT = "category string, normal string, at struct<doc_id:long,seg_no:long,back:int>, original string, use_count long"


def plain(names):
    """normal -> accepted name, of (category, form, core, letters, normal) in order; by comparing with all accepted ones."""
    accepted, out = [], {}
    for name in names:
        category, form, core, letters, normal = name
        for c, f, k, le, n in accepted:
            if (c, f) == (category, form) and (le == letters or max(len(k), len(core)) >= merging.X.FUZZY_LEAST and merging.within_one(k, core)):
                out[category, normal] = n
                break
        else:
            accepted.append(name)
            out[category, normal] = normal
    return out


def family(rng, n, letters="abc", length=12):
    """Names around one core: one, two or three letters changed, put in or taken out, with other punctuation."""
    base, out = [rng.choice(letters) for _ in range(length)], []
    for _ in range(n):
        core = list(base)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(core) + 1)
            core[at : at + rng.randrange(2)] = rng.choice(["", *letters, ".", " "])
        out.append("".join(core).strip() or "a")
    return out


def rows(spark, names):
    return spark.createDataFrame([("COMPANY", n, (i, 0, 0), n, 1) for i, n in enumerate(names)], AT)


def answer(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len({g[:2] for g in got})
    return {g[:2]: g[2] for g in got}


def derived(spark, names):
    form = F.coalesce(merging.X.legal_form(F.col("normal")), F.lit(""))
    df = rows(spark, names).withColumn("form", form)
    core = merging.X.core_name(F.col("normal"), F.when(F.col("form") != "", F.col("form")))
    return [tuple(r) for r in df.withColumn("core", core).withColumn("letters", merging.X.letters_only(F.col("core"))).orderBy("at").select("category", "form", "core", "letters", "normal").collect()]


@pytest.mark.parametrize("few", [0, merging.FEW])
@pytest.mark.parametrize("seed", range(3))
def test_families(spark, seed, few):
    rng, names = random.Random(seed), []
    for length in (1, 3, 6, 7, 8, 13):
        names += [f"{n} {form}".strip() for n in family(rng, 25, length=length) for form in [rng.choice(["gmbh", "ag", ""])]]
    names = list(dict.fromkeys(names))
    rng.shuffle(names)
    assert answer(mapping.merged(rows(spark, names), few=few)) == plain(derived(spark, names))


def chain(n):
    """Names of which each is one letter from the next and from no other: a Gray code of digits of three letters each.

    From one code to the next the three letters of one digit change one after the other.
    """
    code = lambda i: ["abcdefgh"[d if i // 8 ** (k + 1) % 2 == 0 else 7 - d] * 3 for k in range(6) for d in [i // 8**k % 8]]
    names = []
    for i in range(n):
        a, b = code(i), code(i + 1)
        (k,) = [k for k in range(6) if a[k] != b[k]]
        names += ["".join(a[:k]) + b[k][:cut] + a[k][cut:] + "".join(a[k + 1 :]) for cut in range(3)]
    return names


@pytest.mark.parametrize(("n", "order"), [(100_000, "in order"), (20_000, "shuffled")])
def test_long_chains(spark, n, order):
    names = chain(n // 3 + 1)[:n]
    if order == "shuffled":
        random.Random(1).shuffle(names)
    into = merging.greedy(names, names)
    got = answer(mapping.merged(rows(spark, names), few=0))
    assert len(set(names)) == n and {n: got["COMPANY", n] for n in names} == {n: names[k] for n, k in zip(names, into, strict=True)}


@pytest.mark.parametrize("few", [0, merging.FEW])
def test_existing_names_come_first_by_number(spark, few):
    """Number 2 before number 10, and both before what is new, for ids that are strings."""
    new = spark.createDataFrame([("COMPANY", "baaaaaaaaa ag", ("0", 0, 0), "", 1), ("EMAIL", "x", ("0", 0, 1), "", 1)], AT.replace("doc_id:long", "doc_id:string"))
    old = spark.createDataFrame([("<COMPANY_010>", "COMPANY", "aaaaaaaaaa ag", "", 1), ("<COMPANY_002>", "COMPANY", "bbaaaaaaaa ag", "", 1)], mapping.MAPPING)
    got = answer(mapping.merged(new, old, few=few))
    assert got == {("COMPANY", "baaaaaaaaa ag"): "bbaaaaaaaa ag", ("COMPANY", "aaaaaaaaaa ag"): "aaaaaaaaaa ag", ("COMPANY", "bbaaaaaaaa ag"): "bbaaaaaaaa ag", ("EMAIL", "x"): "x"}


@pytest.mark.parametrize("few", [0, merging.FEW])
def test_nothing(spark, few):
    assert answer(mapping.merged(rows(spark, []), few=few)) == {} and answer(mapping.merged(rows(spark, ["a ag"]), few=few)) == {("COMPANY", "a ag"): "a ag"}


def test_rounds_hold_as_many_places_as_asked_for(spark, monkeypatch):
    """However well their rows are compressed, tables of a round are made in parts of NAMES names and PLACES places in hubs."""
    made, write = {}, merging.written
    monkeypatch.setattr(merging, "NAMES", 100, raising=False)
    monkeypatch.setattr(merging, "PLACES", 2000, raising=False)

    def counted(df, name):
        out = write(df, name)
        made.setdefault(name, []).append([r["count"] for r in out.groupBy(F.input_file_name()).count().collect()])
        return out

    monkeypatch.setattr(merging, "written", counted)
    names = ["".join("abcdefghij"[int(d)] for d in f"{i:012d}") + " ag" for i in range(2000)]
    setting = spark.conf.get("spark.sql.shuffle.partitions")
    got = answer(mapping.merged(rows(spark, names), few=0))
    into = merging.greedy([n[:-3] for n in names], [n[:-3] for n in names])
    assert got == {("COMPANY", n): names[k] for n, k in zip(names, into, strict=True)}
    assert max(made["merge-hubs"][0]) < 4000 and max(max(x) for x in made["merge-links"]) < 4000 and max(made["merge-keys"][0]) < 300
    assert spark.conf.get("spark.sql.shuffle.partitions") == setting
