"""Scores of predicted spans against labelled ones: greedy one-to-one matching by category and overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nth_span(text: Column, part: Column, n: Column) -> Column:
    """Struct start, end of the n-th occurrence (from 1) of a part; null if there are fewer."""

    found = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda at, i: F.when((at == 0) & (i > 1), at).otherwise(F.call_function("locate", part, text, at + 1)))
    return F.when(found > 0, F.struct((found - 1).alias("start"), (found - 1 + F.length(part)).alias("end")))


def matched(predicted: Column, truth: Column) -> Column:
    """How many predictions, in order, take a truth of their category that they overlap and none before has taken."""
    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        fits = lambda i: (F.get(truth, i)["category"] == p["category"]) & (F.get(truth, i)["start"] < p["end"]) & (p["start"] < F.get(truth, i)["end"]) & ~F.array_contains(acc["used"], i)
        free = F.when(F.size(truth) > 0, F.filter(F.sequence(F.lit(0), F.size(truth) - 1), fits)).otherwise(F.array().cast("array<int>"))
        hit = F.get(free, F.lit(0))
        return F.when(hit.isNull(), acc).otherwise(F.struct(F.concat(acc["used"], F.array(hit)).alias("used"), (acc["n"] + 1).alias("n")))

    return F.aggregate(predicted, start, step, lambda acc: acc["n"])


def metrics(cases: DataFrame, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """category, tp, fp, fn, precision, recall, f1 of each category, and of OVERALL by rollup.

    Matching is within a row; categories are those of either side. Without predictions precision is 1 if nothing was missed,
    else 0; without truths recall is 1 if nothing was predicted, else 0.
    """
    of = lambda c: lambda s: s["category"] == c
    both = F.array_distinct(F.concat(*(F.transform(c, lambda s: s["category"]) for c in (predicted, truth))))
    rows = cases.select(predicted, truth, F.explode(both).alias("category"))
    own, real = F.filter(predicted, of(F.col("category"))), F.filter(truth, of(F.col("category")))
    rows = rows.select("category", matched(own, real).alias("tp"), F.size(own).alias("p"), F.size(real).alias("t"))
    sums = rows.rollup("category").agg(F.sum("tp").alias("tp"), F.sum(F.col("p") - F.col("tp")).alias("fp"), F.sum(F.col("t") - F.col("tp")).alias("fn"))
    return scored(sums.select(F.coalesce("category", F.lit("OVERALL")).alias("category"), "tp", "fp", "fn").where("tp is not null"))


def scored(sums: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise((fn == 0).cast("double"))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise((fp == 0).cast("double"))
    out = sums.withColumn("precision", precision).withColumn("recall", recall)
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
