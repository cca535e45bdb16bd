"""Arrays of spans: struct start, end (code points, half-open), category, value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,category:string,value:string>>"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once a row, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def none() -> Column:
    return F.array().cast(SPANS)


#: The characters that Unicode calls white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """The text without Unicode white space at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def starts(sizes: Column) -> Column:
    """The sum of the sizes before each of them.

    A fold copies the array that it grows at each step, so it runs over blocks of about the square root of their number.
    """
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct((acc["at"] + n).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    fold = lambda xs: F.aggregate(xs, empty, step)

    def of_blocks(width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / width).cast("int")), lambda k: fold(F.slice(sizes, k * width + 1, width)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, fold(F.transform(bs, lambda b: b["at"]))["out"], lambda b, first: F.transform(b["out"], lambda x: x + first))))

    return F.when(F.size(sizes) > 0, let(F.ceil(F.sqrt(F.size(sizes))).cast("int"), of_blocks)).otherwise(F.array().cast("array<int>"))


def span(start: Column, end: Column, category: Column | str, value: Column) -> Column:
    category = F.lit(category) if isinstance(category, str) else category
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), category.alias("category"), value.alias("value"))


def find_each(text: Column, wanted: list[tuple[str, str, Column | None]]) -> Column:
    """For each (category, pattern, gate) in turn, every match with its offsets, in order. A text that a gate is false of is not scanned.

    Matches and what lies between them give the offsets; both come from one scan each. No pattern may match the empty string.
    """

    def part(category: str, pattern: str, gate: Column | None) -> Column:
        here = F.regexp_like(text, F.lit(pattern))
        both = F.struct(F.lit(category).alias("category"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
        return F.when(here if gate is None else gate & here, both)

    def walk(found: Column) -> Column:
        gaps = F.slice(found["g"], F.lit(1), F.size(found["m"]))
        ends = starts(F.zip_with(gaps, found["m"], lambda g, m: F.length(g) + F.length(m)))  # of the match before
        first = F.zip_with(ends, gaps, lambda e, g: e + F.length(g))
        return F.zip_with(first, found["m"], lambda a, m: span(a, a + F.length(m), found["category"], m))

    return F.flatten(F.transform(F.filter(F.array(*(part(*w) for w in wanted)), lambda p: p.isNotNull()), walk))


def find_all(text: Column, pattern: str, category: str = "") -> Column:
    """Every match of the pattern with its offsets, in order."""
    return find_each(text, [(category, pattern, None)])


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def claim(candidates: Column) -> Column:
    """In the order given, each candidate that overlaps none accepted before; sorted by start."""
    step = lambda acc, x: F.when(F.exists(acc, lambda a: overlap(a, x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.array_sort(F.aggregate(candidates, none(), step))


def stitch(text: Column, spans: Column, value: Callable[[Column], Column]) -> Column:
    """The text with each of the sorted, disjoint spans replaced."""
    before = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    pieces = F.zip_with(before, spans, lambda at, s: F.when(s.isNull(), F.substring(text, at + 1, F.length(text))).otherwise(F.concat(F.substring(text, at + 1, s["start"] - at), value(s))))
    return F.array_join(pieces, "")


def items(values: tuple[str, ...] | str) -> Column:
    """A constant array, folded by the optimiser: one call where a literal for each value would be many."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def contains_any(text: Column, keywords: tuple[str, ...]) -> Column:
    return F.exists(items(keywords), lambda k: F.contains(text, k))


def context(text: Column, start: Column, end: Column, width: int = 60) -> Column:
    """Lower-cased text from `width` code points before the span to as many after it."""
    a = F.greatest(start - width, F.lit(0))
    return F.lower(F.substring(text, a + 1, end + width - a))
