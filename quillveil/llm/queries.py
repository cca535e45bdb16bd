"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.llm import ann, bpe, fingerprint, jaccard, language, licenses, mixing, pii, toxicity, warc
from quillveil.sources.tables import read, spread

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(read(spark, folder, name))


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(_table(spark, folder, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op3_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return ann.search(vectors, vectors.where(F.col("id") % 100 == 0))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compare_edited(_table(spark, folder, "documents"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = warc.write_archives(spark, _table(spark, folder, "pages"))
    return warc.read_archives(spark.read.schema("archive binary").parquet(path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(documents, _table(spark, folder, "labels"))
    return toxicity.score(documents, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    model = language.train(documents)
    return language.predict(documents.select("doc_id", "text"), model).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.find(_table(spark, folder, "documents").select("doc_id", "text"))
    joined = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",")
    total = lambda name: F.aggregate("licenses", F.lit(0).cast("long"), lambda a, x: a + x[name])
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), joined.alias("licenses"), F.array_max(F.transform("licenses", lambda x: x["gain"])).alias("best_gain"), total("missing").alias("words_missing"), total("added").alias("words_added"))


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(_table(spark, folder, "documents").select("doc_id", "text"))
    joined = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_jaccard_join, op2_byte_bpe, op3_nearest_neighbours, op4_fingerprints, op5_warc, op6_curriculum_mix, op7_toxicity, op8_language, op9_license_scan, op10_personal_data)
    import corpus_pipeline

    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM c WHERE 100 * c >= 75 * (n + m - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.reached)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.reached) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.s"""

OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND p.payload_bytes >= 1000"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express over whole tables; tests hold the others against brute force."""
    return {"op1_ngram_jaccard_join": OP1_SQL, "op5_warc": OP5_SQL}
