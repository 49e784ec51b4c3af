"""String functions: matches with places, normal forms, company cores, merge predicate, small formats."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwerk.functions import arrays as A

HIT = "array<struct<start:int,end:int,text:string>>"

# Legal forms of companies in normal form, longest compounds first.
LEGAL_FORMS = (
    "gmbh & co. kg", "gmbh & co kg", "gmbh und co. kg", "gmbh und co kg", "ag & co. kg", "ag & co kg", "ag und co kg", "kgaa", "gmbh", "ohg", "kg", "ag", "se", "og", "ug",
    "eu", "e.u.", "ev", "e.v.", "eg", "e.g.", "gag", "stiftung", "limited", "ltd", "llc", "sarl", "s.a.r.l.", "spa", "s.p.a.",
)
FUZZY_CATEGORIES = ("COMPANY", "ORG")
FUZZY_LEAST = 10


def none() -> Column:
    return F.array().cast(HIT)


def matches(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """Matches of a pattern that is never empty: array of (start, end, text), in code points, end exclusive.

    Splitting at the pattern gives what lies between the matches, so that lengths added up are places. A
    group must end where its match ends.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    told = lambda g: F.regexp_extract_all(text, regex, F.lit(g))
    # What lies between has one more element, which has no match and is dropped.
    sizes = F.zip_with(F.split(text, regex, -1), told(0), lambda gap, whole: F.length(gap) + F.length(whole))
    hit = lambda end, t: F.struct((end - F.length(t)).alias("start"), end.alias("end"), t.alias("text"))
    hits = F.filter(F.zip_with(A.running(sizes), told(group), hit), lambda h: h["text"].isNotNull())
    return F.when(F.rlike(text, regex), hits).otherwise(none())


def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def normalize(text: Column, full: bool = False) -> Column:
    """Normal form of a name: lower case, umlauts spelled out, accents off, punctuation but & and . to spaces.

    Accented Latin letters are mapped natively. full: by compatibility decomposition, in Arrow batches, for
    the texts that have other characters beyond ASCII.
    """
    low = F.lower(F.trim(F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        low = F.replace(low, F.lit(a), F.lit(b))
    plain = F.translate(low, "àáâãåāçćčďèéêëēęěìíîïīłñńňòóôõōřśšťùúûūůýÿžźż", "aaaaaacccdeeeeeeeiiiiilnnnooooorsstuuuuuyyzzz")
    if full:
        plain = F.when(plain.rlike(r"[^\x00-\x7F]"), F.pandas_udf(_decomposed, "string")(low)).otherwise(plain)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s&.]", " "), r"(?U)\s+", " "))


def legal_form(normal: Column) -> Column:
    """The first listed form that ends a normal form; null if none."""
    forms = F.array(*map(F.lit, LEGAL_FORMS))
    return F.get(F.filter(forms, lambda f: (normal == f) | normal.endswith(F.concat(F.lit(" "), f))), 0)


def core_name(normal: Column, form: Column) -> Column:
    """The normal form without its legal form; the whole if nothing else is left."""
    core = F.trim(F.substring(normal, F.lit(1), F.length(normal) - F.length(form)))
    return F.when(form.isNull() | (core == ""), normal).otherwise(core)


def letters_only(x: Column) -> Column:
    return F.regexp_replace(x, "[^a-z0-9]", "")


def should_merge(a: Column, b: Column, category: Column) -> Column:
    """Whether two normal forms are one entity: equal, or for companies with the same legal form, nearly so."""
    form_a, form_b = legal_form(a), legal_form(b)
    core_a, core_b = core_name(a, form_a), core_name(b, form_b)
    near = (F.greatest(F.length(core_a), F.length(core_b)) >= FUZZY_LEAST) & (F.levenshtein(core_a, core_b) <= 1)
    same = letters_only(core_a) == letters_only(core_b)
    return (a == b) | (category.isin(*FUZZY_CATEGORIES) & form_a.eqNullSafe(form_b) & (same | near))


def canonical(category: Column, value: Column) -> Column:
    """Letters and digits in upper case for identifiers; white space folded for names, addresses and the like."""
    worded = category.isin("PERSON", "COMPANY", "ADDRESS", "ORG", "EMAIL", "URL", "BEGRIFF")
    return F.when(worded, F.trim(F.regexp_replace(F.lower(value), r"(?U)\s+", " "))).otherwise(F.regexp_replace(F.upper(value), "[^A-Z0-9]", ""))


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Keyed digest of a text, as hex, in Arrow batches: as an expression it would show the key in the plan."""

    @F.pandas_udf("string")
    def hmac_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return hmac_of(text)


def held(key: bytes):
    """A function of any column that gives the key for each row; plans name the function, not the key."""

    @F.pandas_udf("binary")
    def key_of(rows: pd.Series) -> pd.Series:
        return pd.Series([key] * len(rows))

    return key_of


def counts_json(counts: Column) -> Column:
    """Compact JSON of a map<string,int>, keys in order."""
    keys = F.array_sort(F.map_keys(counts))
    return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.element_at(counts, k).cast("string"))), ","), F.lit("}"))


def counts_told(counts: Column) -> Column:
    """'3x IBAN, 1x URL': by falling count, then by name."""
    pairs = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    return F.array_join(F.transform(pairs, lambda p: F.concat((-p["n"]).cast("string"), F.lit("x "), p["k"])), ", ")


def file_stem(name: Column) -> Column:
    """A file stem without characters that file systems forbid."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', " "), r"\s+", " "))


def slug(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9]+", "_")


def formula_texts(formula: Column, change) -> Column:
    """A spreadsheet formula with change applied to its quoted operands; doubled quotes are unescaped for it."""
    quoted = r'"(?:[^"]|"")*"'
    gaps, texts = F.split(formula, quoted, -1), F.regexp_extract_all(formula, F.lit(quoted), F.lit(0))

    def changed(t: Column) -> Column:
        inner = F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))
        return F.concat(F.lit('"'), F.replace(change(inner), F.lit('"'), F.lit('""')), F.lit('"'))

    pairs = F.zip_with(gaps, F.transform(texts, changed), lambda g, t: F.concat(g, F.coalesce(t, F.lit(""))))
    return F.array_join(pairs, "")


def word_sequences(words: Column, wanted: Column) -> Column:
    """Places (from 0) at which an array of words holds another array of words in a row."""
    n = F.size(wanted)
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: (n > 0) & (F.slice(words, i + 1, n) == wanted))


def reading_variants(text: Column) -> Column:
    """A text, and forms of it without what text recognition tends to get wrong: ß, glued digits and words, glued legal forms."""
    sharp = F.regexp_replace(text, r"(?<=[a-zäöü])B(?=[a-zäöü\s]|$)", "ß")
    split = F.regexp_replace(F.regexp_replace(text, r"(?<=\p{L})(?=\d)", " "), r"(?<=\d)(?=\p{L})", " ")
    forms = F.regexp_replace(text, r"(?<=\p{Ll})(?=(?:GmbH|KG|AG|OG|OHG)(?![\p{L}\p{N}]))", " ")
    camel = F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})", " ")
    return F.array_distinct(F.array(text, sharp, split, forms, camel))


def keywords(title: Column, stop: list[str], least: int = 4, stem: int = 5) -> Column:
    """Stems of a title's words, without stop words and short ones, in order, once each."""
    words = F.split(F.lower(title), r"(?U)[^\w]+")
    kept = F.filter(words, lambda w: (F.length(w) >= least) & ~F.array_contains(F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>"), w))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, stem)))
