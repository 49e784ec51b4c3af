"""An arena of made-up documents: templates x modes x countries, with every secret that was put in.

A template is a text with slots {CATEGORY}; values come from integer keys by arithmetic and valid check digits,
so that any number of documents is a few expressions over a range of ids. Modes are ways in which texts arrive:
clean; reflowed, with line feeds for some spaces; spaced, with two spaces behind full stops; as a list. Rendering
gives texts and the places of their slots.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATES = (
    "Sehr geehrte Damen und Herren,\nHerr {PERSON} ersucht um Zahlung auf {IBAN}. Rückfragen an {EMAIL} oder {PHONE}.\nMit freundlichen Grüßen",
    "Rechnung der {COMPANY}\n{ADDRESS}\nUID: {UID}\nDer Betrag ist auf {IBAN} zu überweisen.",
    "Lohnkonto\nDienstnehmer: {PERSON}\nGeburtsdatum: {DATE}\nKonto {IBAN}, Mail {EMAIL}",
    "Protokoll vom Vormittag\nZeuge: {PERSON}\nwohnhaft {ADDRESS}, erreichbar unter {PHONE}. Frau {PERSON} ist entschuldigt.",
    "Antragsteller: {PERSON}\ngeboren am {DATE}, Karte {CREDITCARD}. Siehe https://www.example.org/antrag",
    "Die {COMPANY} hat mit Frau {PERSON} einen Vertrag geschlossen; Anschrift {ADDRESS}, {EMAIL}.",
)
MODES = ("clean", "reflow", "spacing", "list")
COUNTRIES = ("AT", "DE", "CH")
FIRST, LAST = ("Anna", "Maria", "Thomas", "Michael", "Eva", "Stefan", "Petra", "Josef"), ("Huber", "Gruber", "Bauer", "Wagner", "Pichler", "Steiner", "Moser", "Mayer", "Hofer", "Leitner")
PLACES = {"AT": ("Wien", "Graz", "Linz"), "DE": ("Berlin", "München", "Bremen"), "CH": ("Zürich", "Basel", "Bern")}
LENGTHS = {"AT": 16, "DE": 18, "CH": 17}
SLOT = re.compile(r"\{([A-Z]+)\}")


def _one(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _digits(key: Column, n: int) -> Column:
    """n digits from a key."""
    return F.lpad(F.pmod(key * 48271 + 11, F.lit(10**n)).cast("string"), n, "0")


def _by_country(country: Column, make) -> Column:
    out = F.lit(None).cast("string")
    for c in COUNTRIES:
        out = F.when(country == c, make(c)).otherwise(out)
    return out


def _iban(key: Column, country: str) -> Column:
    """A valid IBAN: 98 minus the rest by 97 of account, country as numbers, and 00."""
    account = F.concat(F.lit("1"), F.lpad(F.pmod(key * 7919 + 3, F.lit(10**12)).cast("string"), LENGTHS[country] - 1, "0"))
    numbers = "".join(str(ord(c) - 55) for c in country)
    rest = F.concat(account, F.lit(numbers + "00")).cast("decimal(38,0)") % 97
    return F.concat(F.lit(country), F.lpad((98 - rest).cast("int").cast("string"), 2, "0"), account)


def _uid(key: Column) -> Column:
    digits = _digits(key, 7)
    digit = lambda i: F.substring(digits, i, 1).cast("int")
    total = sum((digit(i) if i % 2 else F.floor(digit(i) * 2 / 10).cast("int") + digit(i) * 2 % 10 for i in range(1, 8)), F.lit(0))
    return F.concat(F.lit("ATU"), digits, ((10 - (total + 4) % 10) % 10).cast("string"))


def _card(key: Column) -> Column:
    body = F.concat(F.lit("4"), _digits(key, 14))
    digit = lambda i: F.substring(body, i, 1).cast("int")
    total = sum((digit(i) if i % 2 == 0 else F.floor(digit(i) * 2 / 10).cast("int") + digit(i) * 2 % 10 for i in range(1, 16)), F.lit(0))
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def value(category: str, key: Column, country: Column) -> Column:
    """A value of a category for a key."""
    if category == "PERSON":
        return F.concat_ws(" ", _one(FIRST, key), _one(LAST, F.floor(key / len(FIRST))))
    if category == "COMPANY":
        return F.concat(_one(LAST, key), F.lit(" "), _one(("Bau", "Handel", "Technik"), F.floor(key / 7)), _by_country(country, lambda c: F.lit(" AG" if c == "CH" else " GmbH")))
    if category == "ADDRESS":
        place = lambda c: F.concat(F.lpad((F.pmod(key, F.lit(8999)) + 1000).cast("string"), 5 if c == "DE" else 4, "1"), F.lit(" "), _one(PLACES[c], key))
        return F.concat(_one(("Hauptstraße", "Lindengasse", "Ringweg"), key), F.lit(" "), (F.pmod(key, F.lit(98)) + 1).cast("string"), F.lit(", "), _by_country(country, place))
    if category == "PHONE":
        return F.concat(_by_country(country, lambda c: F.lit({"AT": "+43", "DE": "+49", "CH": "+41"}[c])), F.lit(" 664 "), _digits(key, 7))
    if category == "DATE":
        return F.concat(F.lpad((F.pmod(key, F.lit(28)) + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((F.pmod(key, F.lit(12)) + 1).cast("string"), 2, "0"), F.lit("."), (F.pmod(key, F.lit(60)) + 1940).cast("string"))
    if category == "IBAN":
        return _by_country(country, lambda c: _iban(key, c))
    made = {"EMAIL": lambda: F.concat(F.lit("post"), key.cast("string"), F.lit("@beispiel.example")), "UID": lambda: _uid(key), "CREDITCARD": lambda: _card(key)}
    return made[category]()


def rendered(template: str, values: list[Column]) -> tuple[Column, Column]:
    """The text of a template with values in its slots, and the slots' places: array of (category, start, end, value)."""
    parts, names = SLOT.split(template)[::2], SLOT.findall(template)
    text, at, slots = F.lit(parts[0]), F.lit(len(parts[0])), []
    for part, name, v in zip(parts[1:], names, values, strict=True):
        slots.append(F.struct(F.lit(name).alias("category"), at.cast("int").alias("start"), (at + F.length(v)).cast("int").alias("end"), v.alias("value")))
        text, at = F.concat(text, v, F.lit(part)), at + F.length(v) + len(part)
    return text, F.array(*slots)


def corpus(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    """The documents of n numbers."""
    return filled(spark.range(start, start + n).withColumnRenamed("id", "doc_id"))


def filled(rows: DataFrame) -> DataFrame:
    """doc_id, template, mode, country, original (as rendered), text (as it arrives) and slots, a document for each doc_id."""
    rows = rows.withColumns({
        "template": F.pmod("doc_id", F.lit(len(TEMPLATES))).cast("int"), "mode": _one(MODES, F.floor(F.col("doc_id") / len(TEMPLATES))),
        "country": _one(COUNTRIES, F.floor(F.col("doc_id") / (len(TEMPLATES) * len(MODES)))),
    })
    parts = []
    for k, template in enumerate(TEMPLATES):  # a branch for each: one expression for all would be too long for the JVM to compile
        names = SLOT.findall(template)
        made = {f"v{i}": value(c, F.col("doc_id") * 8 + i, F.col("country")) for i, c in enumerate(names)}
        text, slots = rendered(template, [F.col(v) for v in made])
        parts.append(rows.filter(F.col("template") == k).withColumns(made).withColumns({"original": text, "slots": slots}).drop(*made))
    rows = functools.reduce(DataFrame.unionByName, parts)
    shown = F.when(F.col("mode") == "reflow", F.regexp_replace("original", r"(?<=[a-zäöüß,.]) (?=[a-zäöü])", "\n")).when(F.col("mode") == "spacing", F.replace("original", F.lit(". "), F.lit(".  ")))
    shown = shown.when(F.col("mode") == "list", F.concat(F.lit("- "), F.replace("original", F.lit("\n"), F.lit("\n- ")))).otherwise(F.col("original"))
    return rows.withColumn("text", shown)


def secrets(documents: DataFrame) -> DataFrame:
    """doc_id, mode, country, category and value of all that was put in."""
    return documents.select("doc_id", "mode", "country", F.explode("slots").alias("s")).select("doc_id", "mode", "country", "s.category", "s.value")
