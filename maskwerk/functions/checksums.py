"""Check-digit rules of identifiers, as boolean Column expressions. Null in, null out."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31,
    "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "RS": 22, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
# Weights of the nine digits around an Austrian social-security number's check digit.
SVNR_WEIGHTS = (3, 7, 9, 0, 5, 8, 4, 2, 1, 6)


def digit(x: Column, place: int) -> Column:
    """The digit at a place, from 0."""
    return F.substring(x, place + 1, 1).cast("int")


def digits_only(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def characters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _matches(x: Column, pattern: str, rule: Column) -> Column:
    """rule where the form fits, false where it does not, so that no cast ever fails."""
    return F.when(x.isNull(), None).when(x.rlike(pattern), F.coalesce(rule, F.lit(False))).otherwise(False)


def mod97(x: Column) -> Column:
    """Remainder by 97 of digits and letters (A = 10 ... Z = 35), folded character by character."""

    def step(a: Column, c: Column) -> Column:
        return F.when(c >= "A", (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(characters(x), F.lit(0), step)


def valid_iban(x: Column) -> Column:
    plain = F.upper(F.regexp_replace(x, " ", ""))
    lengths = F.create_map(*[F.lit(v) for pair in IBAN_LENGTHS.items() for v in pair])
    fits = F.length(plain) == F.try_element_at(lengths, F.substring(plain, 1, 2))
    turned = F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4))
    return _matches(plain, "^[A-Z]{2}[0-9]{2}[A-Z0-9]+$", fits & (mod97(turned) == 1))


def iso7064(x: Column) -> Column:
    """Check digit by ISO 7064 mod 11, 10 of a string of digits."""

    def step(p: Column, c: Column) -> Column:
        s = (F.ascii(c) - 48 + p) % 10
        return F.when(s == 0, 10).otherwise(s) * 2 % 11

    return (11 - F.aggregate(characters(x), F.lit(10), step)) % 10


def valid_svnr(x: Column) -> Column:
    d = F.regexp_replace(x, " ", "")
    total = sum((digit(d, i) * w for i, w in enumerate(SVNR_WEIGHTS)), F.lit(0))
    day, month = F.substring(d, 5, 2).cast("int"), F.substring(d, 7, 2).cast("int")
    # A remainder of 10 equals no digit.
    return _matches(d, "^[0-9]{10}$", day.between(1, 31) & month.between(1, 12) & (total % 11 == digit(d, 3)))


def valid_at_uid(x: Column) -> Column:
    doubled = lambda i: F.floor(digit(x, i) * 2 / 10).cast("int") + digit(x, i) * 2 % 10
    total = digit(x, 3) + doubled(4) + digit(x, 5) + doubled(6) + digit(x, 7) + doubled(8) + digit(x, 9)
    return _matches(x, "^ATU[0-9]{8}$", (10 - (total + 4) % 10) % 10 == digit(x, 10))


def valid_de_tax_id(x: Column) -> Column:
    d = F.regexp_replace(x, " ", "")
    ten = characters(F.substring(d, 1, 10))
    most = F.array_max(F.transform(ten, lambda c: F.size(F.filter(ten, lambda y: y == c))))
    kinds = F.size(F.array_distinct(ten))
    shape = ((most == 2) & (kinds == 9)) | ((most == 3) & (kinds == 8))
    return _matches(d, "^[0-9]{11}$", shape & (iso7064(F.substring(d, 1, 10)) == digit(d, 10)))


def valid_de_uid(x: Column) -> Column:
    plain = F.upper(F.regexp_replace(x, " ", ""))
    return _matches(plain, "^DE[0-9]{9}$", iso7064(F.substring(plain, 3, 8)) == digit(plain, 10))


def valid_ahv(x: Column) -> Column:
    d = digits_only(x)
    total = sum((digit(d, i) * (3 if i % 2 else 1) for i in range(12)), F.lit(0))
    return _matches(d, "^756[0-9]{10}$", (10 - total % 10) % 10 == digit(d, 12))


def valid_card(x: Column) -> Column:
    d = F.regexp_replace(x, "[ -]", "")
    return _matches(d, "^[0-9]{13,19}$", F.call_function("luhn_check", d))


@lru_cache(1)
def country_codes() -> tuple[str, ...]:
    """ISO 3166 codes, from the Java runtime."""
    return tuple(sorted(SparkSession.active()._jvm.java.util.Locale.getISOCountries()))


def valid_bic(x: Column) -> Column:
    return _matches(x, "^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$", F.substring(x, 5, 2).isin(*country_codes()))
