"""Geometry and text of OCR words: lines, identity documents, fields, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillveil.functions import patterns
from quillveil.functions.spans import let

WORDS = "array<struct<top:int,ord:int,left:int,width:int,height:int,text:string>>"
BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
# Label variants and tolerances of OCR output.
NAME_LABELS = ("nam", "name", "narne", "wame")
FATHER_LABELS = ("father", "father's", "fathers")
SIGNATURE_LABELS = ("sign", "signature")
ADDRESS_LABELS = ("address", "addressl", "addre", "पता")
LINE_TOLERANCE = 12
#: For each document type: keyword, alternatives with the edits that each allows.
KEYWORDS = {
    "pan": (("permanent account number", (("permanent account number", 3),)), ("income tax department", (("income tax department", 3),)), ("pan card", (("pan card", 1),))),
    "aadhaar": (
        ("aadhaar", (("aadhaar", 1), ("aadhar", 0), ("adhar", 0))),
        ("uidai", (("uidai", 1),)),
        ("unique identification authority", (("unique identification authority", 4),)),
        ("government of india", (("government of india", 3), ("govt of india", 2))),
    ),
    "passport": (("passport", (("passport", 1),)), ("republic of india", (("republic of india", 3),)), ("type p", (("type p", 0),))),
}
NUMBERS = {"pan": patterns.PAN, "aadhaar": patterns.AADHAAR, "passport": patterns.PASSPORT}
#: Field, then left, top, right, bottom as shares of the card's width and front height.
FALLBACKS = {
    "pan": (("fallback_photo", 0.02, 0.12, 0.28, 0.75), ("fallback_signature", 0.40, 0.70, 0.85, 0.95)),
    "aadhaar": (("fallback_photo", 0.02, 0.15, 0.28, 0.90), ("fallback_qr", 0.55, 0.15, 0.90, 0.80)),
    "passport": (("fallback_photo", 0.02, 0.20, 0.45, 0.80), ("fallback_signature", 0.45, 0.65, 0.85, 0.90)),
}


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), x2.cast("int").alias("x2"), y2.cast("int").alias("y2"))


def kept_word(text: Column, confidence: Column, least: float = 40.0) -> Column:
    """Whether an OCR word counts: not blank, and of enough confidence."""
    return (F.length(F.trim(text)) > 0) & (confidence >= least)


def rescaled(value: Column, scale: Column) -> Column:
    """A coordinate of the scaled image in the original's pixels, cut to an integer."""
    return (value / scale).cast("int")


def normalized(text: Column) -> Column:
    """Lower case, other characters than letters and digits as blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\p{Alnum}\s]", " "), r"(?U)\s+", " "))


def has_fuzzy(text: Column, target: str, edits: int) -> Column:
    """Whether a window of the target's length is within so many edits; a shorter text is compared whole."""
    n = len(target)
    windows = F.exists(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.levenshtein(F.substring(text, i, F.lit(n)), F.lit(target)) <= edits)
    exact = F.contains(text, F.lit(target))
    if not edits:
        return exact
    return F.when(exact, True).when(F.length(text) < n, F.levenshtein(text, F.lit(target)) <= edits).otherwise(windows)


def classify(raw: Column) -> Column:
    """Struct doc_type, confidence, keywords of the joined words of an image."""

    def judge(clean: Column) -> Column:
        options = []
        for rank, (kind, keywords) in enumerate(KEYWORDS.items()):
            hits = [F.when(_any([has_fuzzy(clean, t, d) for t, d in alternatives]), F.lit(name)) for name, alternatives in keywords]
            found = F.filter(F.array(*hits), lambda k: k.isNotNull())
            number = F.regexp_like(raw, F.lit("(?U)" + NUMBERS[kind]))
            enough = (number & (F.size(found) >= 1)) | (F.size(found) >= 2)
            options.append(F.when(enough, F.struct((F.size(found) + number.cast("int")).alias("score"), F.lit(-rank).alias("rank"), F.lit(kind).alias("doc_type"), number.alias("number"), found.alias("keywords"))))
        best = F.array_max(F.filter(F.array(*options), lambda o: o.isNotNull()))
        return let(best, lambda b: F.struct(F.coalesce(b["doc_type"], F.lit("unknown")).alias("doc_type"), F.when(b["number"], "high").otherwise("low").alias("confidence"), F.coalesce(b["keywords"], F.array().cast("array<string>")).alias("keywords")))

    return let(normalized(raw), judge)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def lines(words: Column) -> Column:
    """Words (WORDS) grouped into lines: a word joins the line whose first word's top is within the tolerance.

    With ascending tops only the latest line can take a word. Words of a line are ordered by left, lines by their first word's top.
    """
    item = "array<struct<anchor:int,words:" + WORDS + ">>"

    def step(acc: Column, w: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = F.struct(last["anchor"].alias("anchor"), F.concat(last["words"], F.array(w)).alias("words"))
        joins = (F.size(acc) > 0) & (w["top"] - last["anchor"] <= LINE_TOLERANCE)
        fresh = F.struct(w["top"].alias("anchor"), F.array(w).alias("words"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    grouped = F.aggregate(F.array_sort(words), F.array().cast(item), step)
    by_left = lambda ws: F.transform(F.array_sort(F.transform(ws, lambda w: F.struct(w["left"].alias("left"), w["top"].alias("top"), w["ord"].alias("ord"), w.alias("w")))), lambda x: x["w"])
    rows = F.transform(grouped, lambda g: let(by_left(g["words"]), lambda ws: F.struct(F.get(ws, F.lit(0))["top"].alias("first"), g["anchor"].alias("anchor"), ws.alias("words"))))
    return F.transform(F.array_sort(rows), lambda r: r["words"])


def bounds(words: Column) -> Column:
    """The smallest box round the words."""
    of = lambda f: F.transform(words, f)
    return box(F.array_min(of(lambda w: w["left"])), F.array_min(of(lambda w: w["top"])), F.array_max(of(lambda w: w["left"] + w["width"])), F.array_max(of(lambda w: w["top"] + w["height"])))


def _bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word["text"], "^:+|:+$", ""))


def _field(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("field"), value.alias("box"))


def fields(words: Column, doc_type: Column) -> Column:
    """Array of struct field, box: labelled values, signatures, addresses, machine-readable lines and fallback areas."""
    has = lambda line, labels: F.exists(line, lambda w: _bare(w).isin(*labels))

    def of_lines(all_lines: Column) -> Column:
        def of_line(line: Column, i: Column) -> Column:
            nothing = F.array().cast(f"array<struct<field:string,box:{BOX}>>")

            def labelled(name: str, labels: tuple[str, ...]) -> Column:
                at = F.get(F.filter(F.transform(line, lambda w, j: F.when(_bare(w).isin(*labels), j)), lambda j: j.isNotNull()), F.lit(0))
                right = F.filter(F.slice(line, at + 2, F.size(line)), lambda w: (F.length(F.regexp_replace(w["text"], r"^[:/\\\- ]+", "")) > 0) & (w["left"] > F.get(line, at)["left"]))
                below = F.get(all_lines, i + 1)
                return let(right, lambda r: F.when(F.size(r) > 0, F.array(_field(name, bounds(r)))).when(below.isNotNull(), F.array(_field(name, bounds(below)))).otherwise(nothing))

            value = F.when(has(line, FATHER_LABELS), labelled("father's name", FATHER_LABELS)).when(has(line, NAME_LABELS), labelled("name", NAME_LABELS)).otherwise(nothing)
            above = F.get(all_lines, i - 1)
            signature = F.when(has(line, SIGNATURE_LABELS) & (i > 0), F.array(_field("signature", bounds(above)))).otherwise(nothing)
            label = F.get(F.filter(line, lambda w: _bare(w).isin(*ADDRESS_LABELS)), F.lit(0))
            region = F.filter(words, lambda w: w["top"].between(label["top"] - 15, label["top"] + 130) & (w["left"] >= label["left"] - 30))
            place = F.when((doc_type == "aadhaar") & label.isNotNull(), F.array(_field("address", bounds(region)))).otherwise(nothing)
            joined = F.array_join(F.transform(line, lambda w: w["text"]), "")
            arrows = F.length(joined) - F.length(F.replace(joined, F.lit("<"), F.lit("")))
            mrz = (arrows >= 5) | F.exists(line, lambda w: F.regexp_like(F.upper(w["text"]), F.lit("^(?:P<|<P)"))) | ((arrows > 0) & (F.length(joined) > 20))
            zone = F.when((doc_type == "passport") & mrz, F.array(_field("mrz", bounds(line)))).otherwise(nothing)
            return F.concat(value, signature, place, zone)

        return F.flatten(F.transform(all_lines, of_line))

    return F.when(F.size(words) > 0, F.concat(let(lines(words), of_lines), fallbacks(words, doc_type))).otherwise(F.array().cast(f"array<struct<field:string,box:{BOX}>>"))


def fallbacks(words: Column, doc_type: Column) -> Column:
    """Areas where a card of the type has its photo, signature or code."""

    def of_card(card: Column) -> Column:
        width, height = card["x2"] - card["x1"], card["y2"] - card["y1"]
        front = F.when(height > 600, F.floor(height / 2)).otherwise(height)
        addressed = F.exists(words, lambda w: F.contains(F.lower(w["text"]), F.lit("address")) | F.contains(w["text"], F.lit("पता")))
        parts = []
        for kind, areas in FALLBACKS.items():
            for name, a, b, c, d in areas:
                wanted = doc_type == kind
                if (kind, name) == ("aadhaar", "fallback_photo"):
                    wanted = wanted & (~addressed | (height > 600))
                area = box(card["x1"] + (width * a).cast("int"), card["y1"] + (front * b).cast("int"), card["x1"] + (width * c).cast("int"), card["y1"] + (front * d).cast("int"))
                parts.append(F.when(wanted, _field(name, area)))
        return F.filter(F.array(*parts), lambda p: p.isNotNull())

    return let(bounds(words), of_card)


def logical_text(all_lines: Column) -> Column:
    """Words of a line joined by blanks, lines by line ends."""
    return F.array_join(F.transform(all_lines, lambda line: F.array_join(F.transform(line, lambda w: w["text"]), " ")), "\n")


def word_spans(all_lines: Column) -> Column:
    """Array of struct start, end, box: where each word stands in the logical text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<start:int,end:int,box:{BOX}>>").alias("out"))
    one = lambda w: box(w["left"], w["top"], w["left"] + w["width"], w["top"] + w["height"])
    step = lambda acc, w: F.struct((acc["at"] + F.length(w["text"]) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(w["text"])).alias("end"), one(w).alias("box")))).alias("out"))
    return F.aggregate(F.flatten(all_lines), start, step, lambda acc: acc["out"])


def boxes_of(word_spans: Column, spans: Column) -> Column:
    """Distinct boxes of the words that any of the spans overlaps."""
    hit = F.filter(word_spans, lambda w: F.exists(spans, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    return F.array_distinct(F.transform(hit, lambda w: w["box"]))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0))


def intersection(a: Column, b: Column) -> Column:
    """The common box, null if there is none."""
    c = box(F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]), F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"]))
    return F.when((c["x2"] > c["x1"]) & (c["y2"] > c["y1"]), c)


def clipped(boxes: Column, width: Column, height: Column) -> Column:
    """Boxes cut to the image; empty ones go."""
    cut = lambda v, most: F.greatest(F.lit(0), F.least(v, most))
    all_cut = F.transform(boxes, lambda b: box(cut(b["x1"], width), cut(b["y1"], height), cut(b["x2"], width), cut(b["y2"], height)))
    return F.filter(all_cut, lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))


def merged(boxes: Column, share: float = 0.4) -> Column:
    """In order, each box joins the first kept one that shares more than `share` of the smaller of both; once only."""

    def step(acc: Column, b: Column) -> Column:
        meets = lambda o: F.coalesce(area(intersection(o, b)) / F.least(area(o), area(b)) > share, F.lit(False))
        at = F.get(F.filter(F.transform(acc, lambda o, i: F.when(meets(o), i)), lambda i: i.isNotNull()), F.lit(0))
        union = lambda o: box(F.least(o["x1"], b["x1"]), F.least(o["y1"], b["y1"]), F.greatest(o["x2"], b["x2"]), F.greatest(o["y2"], b["y2"]))
        return let(F.struct(at.alias("at")), lambda f: F.when(f["at"].isNull(), F.concat(acc, F.array(b))).otherwise(F.transform(acc, lambda o, i: F.when(i == f["at"], union(o)).otherwise(o))))

    return F.aggregate(boxes, F.array().cast(f"array<{BOX}>"), step)


def qr_box(points: Column) -> Column:
    """The box round a code's corner points, cut to integers."""
    of = lambda c: F.transform(points, lambda p: p[c])
    return box(F.array_min(of("x")), F.array_min(of("y")), F.array_max(of("x")), F.array_max(of("y")))
