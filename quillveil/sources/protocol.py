"""The response stream: progress and metrics lines, a marker, then the file; or an error line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stream's format.
PROGRESS, METRICS, ERROR, MARKER = "PROGRESS:", "METRICS:", "ERROR:", "\n---FILE---\n"
COUNTERS = ("paragraphs_scanned", "tables_found", "images_found", "text_redactions", "images_modified")
SCHEMA = "struct<" + ",".join(f"{c}:bigint" for c in COUNTERS) + ">"
STAGES = ("loading_document", "analyzing_text", "cleaning_metadata", "saving_document", "processing_images", "finalizing")


def progress_line(stage: Column, current: Column, total: Column) -> Column:
    return F.concat(F.lit(PROGRESS), F.to_json(F.struct(stage.alias("stage"), current.alias("current"), total.alias("total"))), F.lit("\n"))


def metrics_line(*counters: Column) -> Column:
    return F.concat(F.lit(METRICS), F.to_json(F.struct(*(c.cast("long").alias(n) for n, c in zip(COUNTERS, counters, strict=True)))), F.lit("\n"))


def error_line(message: Column) -> Column:
    return F.concat(F.lit(ERROR), F.to_json(F.struct(message.alias("error"))), F.lit("\n"))


def parsed(raw: Column) -> Column:
    """Struct metrics, file, error of a stream's bytes (as Latin-1, so that each byte is one character)."""
    text = F.decode(raw, "ISO-8859-1")
    at = F.call_function("locate", F.lit(MARKER), text)
    head = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    line = lambda prefix: F.get(F.filter(F.split(head, "\n"), lambda x: x.startswith(prefix)), F.lit(0))
    body = lambda prefix: F.decode(F.encode(F.substring(line(prefix), F.lit(len(prefix) + 1), F.length(line(prefix))), "ISO-8859-1"), "utf-8")
    metrics = F.from_json(body(METRICS), SCHEMA)
    error = F.get_json_object(body(ERROR), "$.error")
    missing = F.when(at == 0, F.coalesce(error, F.lit("Stream missing file marker")))
    data = F.when(at > 0, F.encode(F.substring(text, at + len(MARKER), F.length(text)), "ISO-8859-1"))
    return F.struct(metrics.alias("metrics"), data.alias("file"), F.coalesce(missing, error).alias("error"))
