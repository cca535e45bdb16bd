"""Pattern detectors. Each gives candidate spans; those that need or forbid a context look 60 code points either way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillveil.functions.spans import contains_any, context, find_each

# The patterns and keywords that decide what counts as each category.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
IP = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
PHONE = (
    r"(?<!\d)(?:\+?\s?91[\s-]?)?[6-9]\d{2}[\s-]?\d{3}[\s-]?\d{4}(?!\d)"
    r"|(?<!\d)(?:\+?\s?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?!\d)"
    r"|(?<!\d)(?:0\d{2,3}|(?:\+?\s?91[\s-]?)?\b\d{2,3})[\s-]?\d{3,4}[\s-]?\d{3,4}(?!\d)"
    r"|(?<!\d)0\d{2,3}[\s-]?\d{6,8}(?!\d)"
    r"|(?<!\d)\+\s?\d{1,3}[\s-]?\d{1,4}[\s-]?\d{3,4}[\s-]?\d{3,4}(?!\d)"
)
CARD = r"\b(?:\d[ -]?){13,19}\b"
AADHAAR = r"\b\d{4}\s?\d{4}\s?\d{4}\b"
PASSPORT = r"\b[A-PR-WYa-pr-wy][0-9]{7}\b"
DOB = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b"
NOT_PHONE = ("invoice", "order no", "order number", "cin", "corporate identity number", "isin", "folio", "page", "clause", "section", "regulation")
NEEDS_AADHAAR = ("aadhaar", "aadhar", "unique identification authority", "uidai")
NEEDS_PASSPORT = ("passport", "republic of india", "type p")
NEEDS_DOB = ("date of birth", "dob", "born on", "d.o.b", "janm")

PATTERNS = {"email": EMAIL, "pan": PAN, "ssn": SSN, "ip": IP, "phone": PHONE, "credit_card": CARD, "aadhaar": AADHAAR, "passport": PASSPORT, "dob": DOB}


def luhn_valid(text: Column) -> Column:
    """13 to 19 digits, blanks and hyphens aside, whose checksum holds."""
    digits = F.regexp_replace(text, "[ -]", "")
    return F.when(F.regexp_like(digits, F.lit("^[0-9]{13,19}$")), F.luhn_check(digits) if hasattr(F, "luhn_check") else F.call_function("luhn_check", digits)).otherwise(F.lit(False))


#: Keywords one of which must, or none of which may, stand near a span.
NEEDED = {"aadhaar": NEEDS_AADHAAR, "passport": NEEDS_PASSPORT, "dob": NEEDS_DOB}
FORBIDDEN = {"phone": NOT_PHONE}


def _gate(text: Column, category: str) -> Column | None:
    """A cheap condition without which a text has no span of the category."""
    if category in NEEDED:
        return contains_any(F.lower(text), NEEDED[category])
    digits = r"\d[ -]?\d" if category == "credit_card" else r"\d\d"  # a card's digits may all stand apart
    return {"email": F.contains(text, F.lit("@")), "ip": None}.get(category, F.regexp_like(text, F.lit(digits)))


def found(text: Column, *categories: str) -> Column:
    """Candidate spans of the categories, in this order."""
    near = lambda s, words: contains_any(context(text, s["start"], s["end"]), words)

    def holds(s: Column) -> Column:
        out = F.lit(True)
        for c in categories:
            rule = near(s, NEEDED[c]) if c in NEEDED else ~near(s, FORBIDDEN[c]) if c in FORBIDDEN else luhn_valid(s["value"]) if c == "credit_card" else None
            if rule is not None:
                out = out & ((s["category"] != c) | rule)
        return out

    return F.filter(find_each(text, [(c, "(?U)" + PATTERNS[c], _gate(text, c)) for c in categories]), holds)


DETECTORS = {c: (lambda text, c=c: found(text, c)) for c in PATTERNS}
