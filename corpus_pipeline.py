"""Documents to training tokens: toxic ones go, near copies go but one, personal data is masked, sources are mixed, texts encoded.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns documents of the same columns;
the last returns doc_id, ids, n_tokens and ids_sha256. Nulls and empty texts pass each stage: they are not toxic, copies of
nothing, hold no personal data, and are never taken by the mix. Repeated rows are one document after the second stage. Columns
whose names have no dot pass through as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.llm import bpe, jaccard, mixing, pii, toxicity
from quillveil.llm.queries import VOCABULARY
from quillveil.llm.store import remove, scratch, shared_folder, stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below one half."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, out=("\0score", "\0predicted"))
    return scored.where(F.col("`\0predicted`") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; of rows with equal doc_id and text, one.

    Rows of one doc_id go or stay together otherwise; rows without a doc_id stay.
    """
    groups = jaccard.near_duplicates(docs.select("doc_id", "text")).where("doc_id is not null")
    ids = groups.groupBy("doc_id").agg(F.min(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("rows"))
    marked = stored(ids.where("not first or rows > 1"))
    kept = docs.join(marked, "doc_id", "left_anti").select(*docs.columns)
    again = marked.where("first").select("doc_id")
    if again.limit(1).count():
        kept = kept.unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))
    return kept


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind; n_chars follows."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, by training position; one that is taken in part is cut after a word."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "n_chars"))
    rows = mixing.mix(docs, keep=rest).select("*", F.explode(F.arrays_zip("positions", "parts")).alias("_x"))
    text = F.when(F.col("_x.parts") < F.col("size"), mixing.first_words(F.col("_keep_text"), F.col("_x.parts"))).otherwise(F.col("_keep_text"))
    rows = rows.withColumn("_keep_text", text).withColumn("n_chars", F.length("_keep_text").cast("long"))
    return rows.orderBy("_x.positions", "doc_id").select(*(F.col(f"_keep_{c}").alias(c) if c in rest else F.col(c) for c in docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digest of the ids, of each row."""
    coded = bpe.encode(docs.select("doc_id", "text"), VOCABULARY, public_tokenizers.PATTERN)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"))


STAGES = [("toxicity", without_toxic), ("ngram_jaccard_join", one_of_copies), ("pii", masked), ("mixing", mixed), ("byte_bpe", encoded)]
#: The stages learn a model, follow links and encode by ranks, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written as Parquet in the shared folder and read again.

    A stage's own tables, and the result of the stage before, are removed once it is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
