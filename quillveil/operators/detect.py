"""Detection: all candidates in order of precedence, claimed greedily; write-back of replacements into texts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillveil.functions import address, entities, names, patterns, pseudonym
from quillveil.functions.spans import claim, let, none, overlap, starts, stitch
from quillveil.policy import Policy

#: In this order; "safe" puts cards before phones, so that a phone cannot take part of a spaced card number.
ORDER = {"compat": ("email", "pan", "ssn", "ip", "phone", "credit_card", "aadhaar", "passport", "dob"), "safe": ("email", "pan", "ssn", "ip", "credit_card", "phone", "aadhaar", "passport", "dob")}


def candidates(text: Column, policy: Policy, found: Column | None = None, precedence: str = "compat") -> Column:
    """Candidate spans by precedence: addresses, labelled names, patterns, entities. Branches that the policy excludes are not built."""
    parts = []
    if policy.address:
        parts.append(address.addresses(text, found))
    if policy.name:
        parts.append(names.names(text))
    if wanted := [c for c in ORDER[precedence] if getattr(policy, c)]:
        parts.append(patterns.found(text, *wanted))
    if found is not None and (policy.name or policy.company):
        parts.append(entities.gated(found, policy.name, policy.company))
    return F.concat(*parts) if parts else none()


def detect(df: DataFrame, text: str = "text", policy: Policy = Policy(), found: str | None = "rules", precedence: str = "compat", out: str = "detections") -> DataFrame:  # noqa: B008
    """df with `out`: the claimed spans of the text, sorted by start. Narrow: no shuffle and no Python.

    found: "rules" for entities by rules, None for no entities, or the name of a column that holds them. A null text has no spans.
    """
    return df.withColumn(out, spans(F.col(text), policy, found, precedence))


def spans(text: Column, policy: Policy, found: str | None = "rules", precedence: str = "compat") -> Column:
    """The claimed spans of a text, as one expression."""
    body = F.coalesce(text, F.lit(""))
    if found is None:
        return claim(candidates(body, policy, None, precedence))
    own = entities.rule_entities(body) if found == "rules" else F.coalesce(F.col(found), F.array().cast(entities.ENTITIES))
    return let(own, lambda e: claim(candidates(body, policy, e, precedence)))


def replaced(own: Column) -> Column:
    """Spans with their replacements."""
    return F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"), s["value"].alias("value"), pseudonym.replacement(s["category"], s["value"]).alias("replacement")))


def redact(df: DataFrame, text: str = "text", out: str = "redacted", **options) -> DataFrame:
    """df with `detections` (with replacements) and `out`, the text with each of them replaced; a null text stays null."""
    rows = df.withColumn("detections", replaced(spans(F.col(text), **{"policy": Policy(), **options})))
    return rows.withColumn(out, F.when(F.size("detections") > 0, stitch(F.col(text), F.col("detections"), lambda s: s["replacement"])).otherwise(F.col(text)))


def coalesce_runs(runs: Column) -> Column:
    """Struct text, runs: the joined text, and the non-empty runs with their index and offsets."""

    def joined(own: Column) -> Column:
        first = starts(F.transform(own, F.length))
        rows = F.transform(F.zip_with(own, first, lambda r, a: F.struct(r.alias("r"), a.alias("a"))), lambda x, i: F.struct(i.alias("run_index"), x["a"].alias("start"), (x["a"] + F.length(x["r"])).alias("end"), x["r"].alias("text")))
        return F.struct(F.array_join(own, "").alias("text"), F.filter(rows, lambda r: r["end"] > r["start"]).alias("runs"))

    return let(F.transform(runs, lambda r: F.coalesce(r, F.lit(""))), joined)


def write_runs(runs: Column, replacements: Column) -> Column:
    """Runs (run_index, start, end, text) with the spans written back: a replacement goes into the first run that its span overlaps."""

    def rewrite(run: Column) -> Column:
        own = F.filter(replacements, lambda s: overlap(s, run))
        start = F.struct(run["start"].alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(run["text"], acc["at"] - run["start"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            first = (s["start"] >= run["start"]) & (s["start"] < run["end"])
            return F.struct(F.least(s["end"], run["end"]).alias("at"), F.concat(acc["out"], gap, F.when(first, s["replacement"]).otherwise(F.lit(""))).alias("out"))

        text = F.aggregate(own, start, step, lambda acc: F.concat(acc["out"], F.substring(run["text"], acc["at"] - run["start"] + 1, F.length(run["text"]))))
        return F.struct(run["run_index"].alias("run_index"), text.alias("text"))

    return F.transform(runs, rewrite)


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """Detections by category and keys; the counting is partial before its one small shuffle.

    The outer explode keeps the optimiser from inferring filters that would detect everything again.
    """
    rows = df.select(*keys, F.explode_outer("detections").alias("d")).select(*keys, F.col("d.category").alias("category"))
    return rows.groupBy(*keys, "category").agg(F.count("category").alias("n")).where("category is not null")


def exploded(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each detection: keys, ord (from 1), start, end, category, value."""
    rows = df.select(*keys, F.posexplode_outer("detections").alias("i", "d")).where("i is not null")
    return rows.select(*keys, (F.col("i") + 1).alias("ord"), F.col("d.start").alias("start"), F.col("d.end").alias("end"), F.col("d.category").alias("category"), F.col("d.value").alias("value"))


