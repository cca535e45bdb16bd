"""Mixing sources to target weights along a curriculum, with DataFrame functions only.

Targets: the sources, by code point with null last, get the weights 5, 2, 1, repeating, and share the words of all documents
by them. No target exceeds `most` times its source's words; what that cuts off is shared by weight among the others. So
target = min(most * words, level * weight), and the level follows from the sources ordered by most * words / weight.

Curriculum: at time t in 0..1 a source is drawn at the rate target * (1 + slope * (1 - 2t)); its slope falls evenly from 1 for
the first source to -1 for the last, so that early sources fade out and late ones fade in. The integral of the rate, target *
(t + slope * t * (1 - t)), is the source's cumulative demand. A source's documents, in the order of a hash, supply that demand
pass after pass; the words before an occurrence are its demand, and the time at which the integral reaches it is its position.
The result is range-sorted by position.

A source's documents are dealt into hash ranges; running sums over groups of ranges, ranges and within a range give each
document's place, so no task holds a source. The last document that a source's target reaches is taken in part.

Edge cases: a null or empty text has size 0 and is never taken; null is a source of its own; repeated rows are documents of
their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillveil.llm.store import stored

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents of a source in a hash range, about, and ranges of a source whose running sums one task makes.
RANGE_ROWS, GROUP = 1024, 4096
#: The table of sources is broadcast up to this many rows (about 1 MB); beyond that it is joined by a shuffle in SALTS parts.
FEW_SOURCES, SALTS = 10_000, 64
_WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Words of the text; those of null are none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Rows (number, source_size) to rows with weight, target and slope. A row a source: few, whatever the corpus."""
    everything = W.partitionBy(F.lit(1))
    rows = sizes.select("*", F.count("*").over(everything).alias("_sources"), F.sum("source_size").over(everything).cast("double").alias("_all"))
    rows = rows.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    by_ratio = everything.orderBy("_ratio", "number").rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0))) / rest  # if all before are at their caps
    rows = rows.withColumn("_level", level)
    rows = rows.withColumn("_at", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "number", "_level"))).over(everything))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_at._level") * F.col("weight"), F.col("_cap")))
    slope = F.when(F.col("_sources") > 1, 1 - 2 * F.col("number") / (F.col("_sources") - 1)).otherwise(F.lit(0.0))
    return rows.select(*sizes.columns, "weight", target.alias("target"), slope.cast("double").alias("slope"))


def _time(demand: Column, target: Column, slope: Column) -> Column:
    """The t in 0..1 at which target * (t + slope * t * (1 - t)) reaches the demand."""
    share = F.least(F.lit(1.0), F.try_divide(demand, target))
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + slope) * (1 + slope) - 4 * slope * share))
    return F.when(target > 0, 2 * share / F.greatest(1 + slope + root, F.lit(1e-300)))


def _numbered(rows: DataFrame) -> tuple[DataFrame, bool]:
    """Rows (source, number, ranges) of each source, and whether they are few. Reads no text."""
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    named = W.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    table = stored(counts.select("source", (F.row_number().over(named) - 1).alias("number"), F.ceil(F.col("n") / RANGE_ROWS).alias("ranges")))
    return table, table.count() <= FEW_SOURCES


def _starts(sums: DataFrame) -> DataFrame:
    """Rows (number, range, sum) to (number, range, start): the words of the source's ranges before, by two steps of sums."""
    rows = sums.withColumn("group", F.floor(F.col("range") / GROUP))
    before = lambda value, w: F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = rows.groupBy("number", "group").agg(F.sum("sum").alias("sum"))
    groups = groups.select("number", "group", before("sum", W.partitionBy("number").orderBy("group")).alias("first"))
    rows = rows.withColumn("start", before("sum", W.partitionBy("number", "group").orderBy("range")))
    return rows.join(groups, ["number", "group"]).select("number", "range", (F.col("first") + F.col("start")).alias("start"))


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (of the first occurrence), positions, parts.

    `taken` counts words, repeats included; `positions` has the position of each occurrence and `parts` the words that it
    takes. `keep` names further columns to pass on, which move once, to the task of their range. The order within a source is
    that of a hash of doc_id and text, so reruns agree.
    """
    rows = documents.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        words(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "text").alias("_h"),
        *(F.col(f"`{c}`").alias(f"_keep_{c}") for c in keep),
    )
    table, few = _numbered(rows)
    named = table.withColumnRenamed("source", "_s")
    same = F.col("source").eqNullSafe(F.col("_s"))
    if few:
        rows = rows.join(F.broadcast(named), same)
    else:  # a source may hold a third of all rows
        named = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_part", F.pmod(F.col("_h"), F.lit(SALTS)).cast("int"))
        rows = rows.join(named, same & (F.col("_part") == F.col("_salt"))).drop("_part", "_salt")
    # From here on a source is its number, which is never null: window and join share one dealing of the rows.
    rows = rows.drop("_s", "source").withColumn("range", F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * F.col("ranges")).cast("long")).drop("ranges")
    sums = stored(rows.groupBy("number", "range").agg(F.sum("size").alias("sum")))
    plan = targets(sums.groupBy("number").agg(F.sum("sum").alias("source_size")), weights, most)
    starts = _starts(sums).join(plan, "number").select("number", "range", "start", "source_size", "target", "slope")
    own = W.partitionBy("number", "range").orderBy("_h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(own), F.lit(0))).join(stored(starts), ["number", "range"])
    wanted = F.round("target").cast("long")
    place = F.col("start") + F.col("_inside")
    passes = F.sequence(F.lit(0), F.lit(int(most)))
    drawn = F.transform(passes, lambda p: F.struct((p * F.col("source_size") + place).alias("demand"), F.greatest(F.lit(0), F.least(F.col("size"), wanted - p * F.col("source_size") - place)).alias("part")))
    rows = rows.withColumn("_drawn", F.filter(drawn, lambda d: d["part"] > 0))
    rows = rows.withColumn("positions", F.transform("_drawn", lambda d: _time(d["demand"].cast("double"), F.col("target"), F.col("slope"))))
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.aggregate("_drawn", F.lit(0).cast("long"), lambda a, d: a + d["part"]).alias("taken"),
        F.get("positions", F.lit(0)).alias("position"),
        "positions",
        F.transform("_drawn", lambda d: d["part"]).alias("parts"),
        *(F.col(f"_keep_{c}") for c in keep),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*" + _WORD), F.lit(0)), F.lit(1), n.cast("int")), "")
