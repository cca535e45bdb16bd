"""spark-submit redact_docx.py --input FILE_OR_FOLDER --output FOLDER [--boxes TABLE] [--codec MODULE:FUNCTION]

TABLE is a Parquet table (path, zip_name, boxes) of the areas of images to mask, such as `plans.documents.image_boxes` makes.
FUNCTION makes the codec of images other than 8-bit PNG, as `plans.documents.Codec` says. Progress goes to standard error, a line for each stage and each file."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from pyspark.sql import SparkSession

from quillveil.plans.documents import SUMMARY, redact_documents
from quillveil.sources.docx import files
from quillveil.sources.protocol import PROGRESS


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Redact personal data in DOCX files")
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--boxes")
    parser.add_argument("--codec")
    own = parser.parse_args(args)
    spark = SparkSession.builder.appName("redact").getOrCreate()
    progress = lambda stage, current, total: print(PROGRESS + json.dumps({"stage": stage, "current": current, "total": total}), file=sys.stderr)
    source = files(spark, own.input)
    total, failed = source.select("path").count(), 0
    progress("loading_document", 0, total)
    os.makedirs(own.output, exist_ok=True)
    boxes = spark.read.parquet(own.boxes) if own.boxes else None
    module, _, function = (own.codec or "").partition(":")
    codec = getattr(importlib.import_module(module), function) if own.codec else None
    for n, row in enumerate(redact_documents(source, boxes=boxes, codec=codec).toLocalIterator(), 1):
        progress("saving_document", n, total)
        if row.status == "failed":
            failed += 1
            print(f"{row.path}: {row.message}", file=sys.stderr)
            continue
        with open(os.path.join(own.output, os.path.basename(row.path)), "wb") as f:
            f.write(row.output)
        print(row.path, *(f"{c}={row[c]}" for c in SUMMARY))
    progress("finalizing", total, total)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
