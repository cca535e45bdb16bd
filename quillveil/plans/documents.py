"""Redaction of DOCX files: text and images branch by file and meet again in one rewrite for each file."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.operators import images as plans
from quillveil.operators.detect import coalesce_runs, detect, replaced, write_runs
from quillveil.policy import Policy
from quillveil.sources import docx, png

SUMMARY = ("paragraphs_scanned", "tables_found", "images_found", "text_redactions", "images_modified")


def text_patches(paragraphs: DataFrame, policy: Policy, precedence: str = "compat") -> DataFrame:
    """Paragraph rows with text, detections and the runs as they are to be written."""
    rows = paragraphs.withColumn("_c", coalesce_runs(F.col("runs"))).withColumn("text", F.col("_c.text"))
    rows = detect(rows, "text", policy, precedence=precedence).withColumn("detections", replaced(F.col("detections")))
    return rows.withColumn("written", F.when(F.size("detections") > 0, write_runs(F.col("_c.runs"), F.col("detections")))).drop("_c")


#: Builds, once in each task, a function of an image's bytes and boxes (x1, y1, x2, y2) to the bytes with these areas filled.
Codec = Callable[[], Callable[[bytes, list[tuple[int, int, int, int]]], bytes]]


def _masked(content: bytes, areas: list[tuple[int, int, int, int]], other: Callable | None) -> bytes:
    """The image with the areas filled, by the PNG codec, or by the other one where that cannot read it."""
    try:
        return png.masked(content, areas)
    except ValueError:
        if other is None:
            raise
    try:
        out = other(content, areas)
    except Exception as e:  # whatever a foreign codec raises fails this image's document alone
        raise ValueError(f"Could not decode image: {e}") from e
    if not out or (areas and out == content):
        raise ValueError("Could not mask image")
    return out


def mask_images(media: DataFrame, boxes: DataFrame | None, visual: bool, codec: Codec | None = None) -> DataFrame:
    """Media rows (path, zip_name, content, error) to (path, zip_name, masked, modified, error).

    boxes: (path, zip_name, boxes) of the images to mask. An image that neither the PNG codec nor `codec` can read fails its
    document while a visual policy is on.
    """
    rows = media.join(boxes, ["path", "zip_name"], "left") if boxes is not None else media.withColumn("boxes", F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>"))

    def run(batches):
        other = codec() if codec else None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out, changed, errors = [], [], []
            for _, _, content, error, areas in zip(*columns, strict=True):
                if error is not None:
                    out.append(None)
                    changed.append(False)
                    errors.append(error)
                    continue
                wanted = [(b["x1"], b["y1"], b["x2"], b["y2"]) for b in areas or []]
                try:
                    out.append(_masked(content, wanted, other) if visual else content)
                    changed.append(bool(visual and wanted))
                    errors.append(None)
                except ValueError as e:
                    out.append(None)
                    changed.append(False)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(changed), pa.array(errors, pa.string())], names=["path", "zip_name", "masked", "modified", "error"])

    return rows.select("path", "zip_name", "content", "error", "boxes").mapInArrow(run, "path string, zip_name string, masked binary, modified boolean, error string")


def redact_documents(files: DataFrame, policy: Policy = Policy(), boxes: DataFrame | None = None, precedence: str = "compat", codec: Codec | None = None) -> DataFrame:  # noqa: B008
    """Rows (path, length, content) to path, status, message, output and the counters of SUMMARY.

    A document whose package or any image cannot be read or rewritten, or whose file is refused, fails: its output is null.
    """
    checked = docx.validated(files)
    good = checked.where("error is null")
    paragraphs = docx.paragraphs(good)
    rows = text_patches(paragraphs.where("error is null"), policy, precedence)
    run = F.struct("part", "para_id", "written")
    tables = F.regexp_extract("location", r"^(?:table\d+)", 0)
    text = rows.groupBy("path").agg(
        F.count("*").alias("paragraphs_scanned"),
        F.countDistinct(F.when(tables != "", tables)).alias("tables_found"),
        F.sum(F.size("detections")).alias("text_redactions"),
        F.collect_list(F.when(F.col("written").isNotNull(), run)).alias("patches"),  # of one document
    )
    visual = policy.faces or policy.id_documents or policy.signatures or policy.qr
    pictures = mask_images(docx.media(good), boxes, visual, codec)
    pictures = pictures.groupBy("path").agg(F.count("*").alias("images_found"), F.sum(F.col("modified").cast("long")).alias("images_modified"), F.max("error").alias("image_error"), F.collect_list(F.when(F.col("modified"), F.struct("zip_name", "masked"))).alias("images"))
    failed = paragraphs.where("error is not null").select("path", F.col("error").alias("open_error"))
    joined = checked.join(text, "path", "left").join(pictures, "path", "left").join(failed, "path", "left")
    joined = joined.withColumn("message", F.coalesce("error", "open_error", "image_error"))

    def patch(batches):
        for batch in batches:
            out, messages = [], batch.column(2).to_pylist()
            for n, (content, patches, images) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 3, 4)), strict=True)):
                made = None
                if messages[n] is None:
                    runs = [(p["part"], p["para_id"], r["run_index"], r["text"]) for p in patches or [] for r in p["written"]]
                    try:
                        made = docx.patched(content, runs, {i["zip_name"]: i["masked"] for i in images or []})
                    except docx.DAMAGE as e:
                        messages[n] = f"Could not write DOCX file: {e}"
                out.append(made)
            status = pa.array(["done" if m is None else "failed" for m in messages])
            yield pa.RecordBatch.from_arrays([batch.column(0), status, pa.array(messages, pa.string()), pa.array(out, pa.binary()), *batch.columns[5:]], names=["path", "status", "message", "output", *SUMMARY])

    ready = joined.select("path", "content", "message", "patches", "images", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in SUMMARY))
    return ready.mapInArrow(patch, "path string, status string, message string, output binary, " + ", ".join(f"{c} long" for c in SUMMARY))


def image_boxes(images: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Rows for `plans.plan` whose image_id is path, a line end and zip_name, to (path, zip_name, boxes)."""
    parts = F.split("image_id", "\n")
    return plans.plan(images, policy).select(parts[0].alias("path"), parts[1].alias("zip_name"), "boxes")


def register(spark: SparkSession) -> None:
    """The SQL table function docx_paragraphs(content)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="part: string, part_ord: int, para_id: int, location: string, runs: array<string>")
    class Paragraphs:
        def eval(self, content: bytes):
            yield from docx.paragraphs_of(bytes(content))

    spark.udtf.register("docx_paragraphs", Paragraphs)
