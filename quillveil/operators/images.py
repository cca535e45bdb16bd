"""Which areas of an image to mask, from its OCR words, faces and codes; no image library is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.functions import layout
from quillveil.functions.spans import claim, find_all, let, none
from quillveil.operators.detect import candidates
from quillveil.policy import Policy


def words_of(ocr: DataFrame) -> DataFrame:
    """OCR rows (image_id, ord, text, left, top, width, height, conf) to one row an image: words (layout.WORDS), raw.

    An image's words are as many as a page holds.
    """
    kept = ocr.where(layout.kept_word(F.col("text"), F.col("conf")))
    item = F.struct(*(F.col(c).cast("int").alias(c) for c in ("top", "ord", "left", "width", "height")), F.col("text"))
    rows = kept.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).cast(layout.WORDS).alias("words"))
    by_ord = F.array_sort(F.transform("words", lambda w: F.struct(w["ord"].alias("o"), w["text"].alias("t"))))
    return rows.withColumn("raw", F.array_join(F.transform(by_ord, lambda x: x["t"]), " "))


def plan(images: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Rows (image_id, width, height, words, raw, faces, codes) to counts and the boxes to mask.

    faces: array of boxes; codes: array of arrays of corner points. Fields, fallbacks and codes are masked only on identity
    documents recognised with high confidence; there the document's own number needs no context beside it.
    """
    empty = F.array().cast(f"array<{layout.BOX}>")
    rows = images.withColumn("words", F.coalesce("words", F.array().cast(layout.WORDS)))
    rows = rows.withColumn("class", layout.classify(F.coalesce("raw", F.lit("")))).withColumn("_lines", layout.lines(F.col("words")))
    rows = rows.withColumn("_text", layout.logical_text(F.col("_lines"))).withColumn("_spans", layout.word_spans(F.col("_lines")))
    rows = rows.withColumn("_pii", layout.boxes_of(F.col("_spans"), claim(candidates(F.col("_text"), policy))))
    sure = (F.col("class.doc_type") != "unknown") & (F.col("class.confidence") == "high")
    rows = rows.withColumn("_sure", sure)
    found = layout.fields(F.col("words"), F.col("class.doc_type"))
    rows = rows.withColumn("_fields", F.when(F.col("_sure"), found).otherwise(F.array().cast(f"array<struct<field:string,box:{layout.BOX}>>")))
    signed = F.exists("_fields", lambda f: f["field"] == "signature")
    gate = lambda f: (
        F.when(f["field"] == "signature", F.lit(policy.signatures))
        .when(f["field"] == "fallback_photo", F.lit(policy.id_documents))
        .when(f["field"] == "fallback_signature", ~signed & F.lit(policy.signatures))
        .when(f["field"] == "fallback_qr", F.lit(policy.qr))
        .otherwise(F.lit(True))
    )
    rows = rows.withColumn("_masked", F.filter("_fields", gate))
    number = none()
    for kind, pattern in (("aadhaar", policy.aadhaar), ("passport", policy.passport)):
        if pattern:
            number = F.when(F.col("class.doc_type") == kind, find_all(F.col("_text"), "(?U)" + layout.NUMBERS[kind])).otherwise(number)
    own = F.when(F.col("_sure"), layout.boxes_of(F.col("_spans"), number)).otherwise(empty)
    faces = F.coalesce("faces", empty) if policy.faces else empty
    codes = F.when(F.col("_sure") & F.lit(policy.qr), F.transform(F.coalesce("codes", F.array()), layout.qr_box)).otherwise(empty) if policy.qr else empty
    rows = rows.withColumn("_faces", faces).withColumn("_codes", codes)
    rows = rows.withColumn("_all", F.concat("_pii", F.transform("_masked", lambda f: f["box"]), own, "_faces", "_codes"))
    rows = rows.withColumn("boxes", let(layout.clipped(F.col("_all"), F.col("width"), F.col("height")), layout.merged))
    count = lambda names: F.size(F.filter("_masked", lambda f: f["field"].isin(*names))).cast("long")
    return rows.select(
        "image_id",
        F.col("class.doc_type").alias("doc_type"),
        F.col("class.confidence").alias("doc_confidence"),
        F.size("_pii").cast("long").alias("text_pii_boxes_masked"),
        F.size("_faces").cast("long").alias("faces_masked"),
        F.size(F.filter("_fields", lambda f: ~f["field"].startswith("fallback_"))).cast("long").alias("id_fields_masked"),
        count(["fallback_photo"]).alias("photo_regions_masked"),
        count(["signature", "fallback_signature"]).alias("signatures_masked"),
        F.size("_codes").cast("long").alias("qr_codes_masked"),
        count(["fallback_qr"]).alias("qr_fallback_masked"),
        (F.size("boxes") > 0).alias("modified"),
        "boxes",
    )
