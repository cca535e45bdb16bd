"""Consistent replacements: a pure function of category and value, so no state, join or shuffle is needed.

The seed is the hash of category and lower-cased, stripped value, modulo 2**32; further digits come from a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillveil.functions.spans import items, let, strip

FIRST = ("Aarav", "Alex", "Anita", "Bela", "Carl", "Dana", "Elena", "Farid", "Grace", "Hugo", "Ines", "Jonas", "Kavya", "Lina", "Marco", "Nadia", "Oscar", "Priya", "Quentin", "Rosa")
LAST = ("Abbott", "Bauer", "Castro", "Desai", "Ekman", "Fischer", "Grover", "Hansen", "Iyer", "Jensen", "Keller", "Lopez", "Morgan", "Nair", "Olsen", "Patel", "Quist", "Romero", "Sato", "Turner")
FIRMS = ("Northgate", "Bluefield", "Harbour", "Redwood", "Summit", "Lakeview", "Orchid", "Granite", "Meridian", "Silverline")
FORMS = ("Holdings", "Industries", "Partners", "Systems", "Trading")
STREETS = ("Acacia Road", "Birch Lane", "Cedar Street", "Dover Avenue", "Elm Close", "Forest Way", "Garden Street", "Hill Road")
TOWNS = ("Ashford", "Brookfield", "Clayton", "Dunmore", "Easton", "Fairview", "Greenville", "Hilltop")
HOSTS = ("example.com", "example.org", "example.net")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PASSPORT_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
#: Dates of birth fall in the 40 years from this day.
ANCHOR = "1964-01-01"


def _key(category: Column | str, value: Column) -> Column:
    category = F.lit(category) if isinstance(category, str) else category
    return F.concat(category, F.lit(":"), F.lower(strip(value)))


def seed(category: Column | str, value: Column) -> Column:
    return F.conv(F.substring(F.sha2(_key(category, value), 256), 57, 8), 16, 10).cast("long")


def _hex(category: Column | str, value: Column) -> Column:
    return F.sha2(F.concat(_key(category, value), F.lit("#")), 256)


def _digits(category: Column | str, value: Column) -> Column:
    """64 decimal digits."""
    return F.translate(_hex(category, value), "abcdef", "012345")


def _pick(pool: tuple[str, ...] | str, n: Column) -> Column:
    return F.get(items(pool), (n % len(pool)).cast("int"))


def _letter(digits: Column, at: int, pool: str = _LETTERS) -> Column:
    return _pick(pool, F.substring(digits, at, 3).cast("int"))


def name(value: Column) -> Column:
    """First and last name; with an initial only, if more than 1.6 times the value's length plus 4."""
    s = seed("name", value)
    first, last = _pick(FIRST, s), _pick(LAST, F.floor(s / len(FIRST)))
    full = F.concat(first, F.lit(" "), last)
    return F.when(F.length(full) > F.length(value) * 1.6 + 4, F.concat(first, F.lit(" "), F.substring(last, 1, 1), F.lit("."))).otherwise(full)


def email(value: Column) -> Column:
    s = seed("email", value)
    return F.concat(F.lower(_pick(FIRST, s)), F.lit("."), F.lower(_pick(LAST, F.floor(s / 20))), (F.floor(s / 400) % 1000).cast("string"), F.lit("@"), _pick(HOSTS, s))


def phone(value: Column) -> Column:
    """Digit for digit, the first from 6 to 9, all else kept."""
    digits = F.concat((6 + seed("phone", value) % 4).cast("string"), _digits("phone", value))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
    is_digit = lambda c: F.regexp_like(c, F.lit("^[0-9]$"))
    step = lambda acc, c: F.struct(F.concat(acc["out"], F.when(is_digit(c), F.substring(digits, acc["i"] % 64 + 1, 1)).otherwise(c)).alias("out"), (acc["i"] + is_digit(c).cast("int")).alias("i"))
    return F.aggregate(F.split(value, ""), start, step, lambda acc: acc["out"])


def company(value: Column) -> Column:
    s = seed("company", value)
    return F.concat(_pick(FIRMS, s), F.lit(" "), _pick(FORMS, F.floor(s / 10)), F.lit(" Ltd"))


def address(value: Column) -> Column:
    s = seed("address", value)
    return F.concat((1 + s % 200).cast("string"), F.lit(" "), _pick(STREETS, F.floor(s / 200)), F.lit(", "), _pick(TOWNS, F.floor(s / 1600)), F.lit(" "), F.lpad((F.floor(s / 12800) % 100000).cast("string"), 5, "0"))


def ssn(value: Column) -> Column:
    d = _digits("ssn", value)
    return F.concat(F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 2), F.lit("-"), F.substring(d, 6, 4))


def credit_card(value: Column) -> Column:
    """16 digits that start with 4 and pass the checksum."""

    def close(body: Column) -> Column:
        at = F.sequence(F.lit(1), F.lit(15))

        def add(acc: Column, i: Column) -> Column:
            d = F.substring(body, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
            return acc + F.when(d > 9, d - 9).otherwise(d)

        return F.concat(body, ((10 - F.aggregate(at, F.lit(0), add) % 10) % 10).cast("string"))

    return let(F.concat(F.lit("4"), F.substring(_digits("credit_card", value), 1, 14)), close)


def dob(value: Column) -> Column:
    """A date in the form of the value: with a month's name, with slashes, or with hyphens."""
    day = F.date_add(F.to_date(F.lit(ANCHOR)), (seed("dob", value) % 14610).cast("int"))
    slashes = F.length(value) - F.length(F.replace(value, F.lit("/"), F.lit("")))
    return F.when(F.regexp_like(value, F.lit("[A-Za-z]")), F.date_format(day, "MMMM dd, yyyy")).when(slashes == 2, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd-MM-yyyy"))


def ip(value: Column) -> Column:
    """A public address."""
    s = seed("ip", value)
    return F.concat_ws(".", (11 + s % 89).cast("string"), (F.floor(s / 89) % 256).cast("string"), (F.floor(s / 22784) % 256).cast("string"), (1 + F.floor(s / 5832704) % 254).cast("string"))


def pan(value: Column) -> Column:
    d = _digits("pan", value)
    return F.concat(*(_letter(d, 1 + 3 * i) for i in range(5)), F.substring(d, 20, 4), _letter(d, 30))


def aadhaar(value: Column) -> Column:
    d = _digits("aadhaar", value)
    return F.concat_ws(" ", F.substring(d, 1, 4), F.substring(d, 5, 4), F.substring(d, 9, 4))


def passport(value: Column) -> Column:
    d = _digits("passport", value)
    return F.concat(_letter(d, 1, _PASSPORT_LETTERS), F.substring(d, 10, 7))


MAKERS = {"name": name, "email": email, "phone": phone, "company": company, "address": address, "ssn": ssn, "credit_card": credit_card, "dob": dob, "ip": ip, "pan": pan, "aadhaar": aadhaar, "passport": passport}


def replacement(category: Column, value: Column, categories: tuple[str, ...] = tuple(MAKERS)) -> Column:
    """The replacement of a value, by its category."""
    out = F.when(category == categories[0], MAKERS[categories[0]](value))
    for c in categories[1:]:
        out = out.when(category == c, MAKERS[c](value))
    return out
