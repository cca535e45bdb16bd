"""Taggers, readers and finders of one's own, run on Arrow batches: entities of texts; words, faces and codes of images.

`make` builds the model; it is called once in each task, on the executor (a `make` of an installed module that caches its model
builds it once a worker). The model is a function from a
list of inputs to a list of results of the same length; an input that is null is not passed to it and has no results.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillveil.functions.entities import ENTITIES
from quillveil.functions.layout import BOX

#: Entity labels that detection knows, and texts that a tagger is given at once.
LABELS = ("PERSON", "ORG", "GPE", "LOC", "FAC")
BATCH = 64


def _applied(df: DataFrame, source: str, out: str, kind: str, make: Callable, arrow: pa.DataType, shape: Callable, batch: int) -> DataFrame:
    names = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out, T._parse_datatype_string(kind))])

    def run(batches):
        model = make()
        for rows in batches:
            values = rows.column(0).to_pylist()
            known, results = [i for i, v in enumerate(values) if v is not None], [[] for _ in values]
            for a in range(0, len(known), batch):
                at = known[a : a + batch]
                found = list(model([values[i] for i in at]))
                if len(found) != len(at):
                    raise ValueError(f"{len(found)} results of {len(at)} inputs")
                for i, own in zip(at, found, strict=True):
                    results[i] = [shape(x) for x in own]
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(results, arrow)], names=[*names, out])

    return df.select(F.col(source).alias("\0source"), *(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def with_entities(df: DataFrame, make: Callable, text: str = "text", out: str = "entities", batch: int = BATCH) -> DataFrame:
    """df with `out` for `detect(found=out)`. A model gives (start, end, label) in code points; other labels than LABELS are left out."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
    rows = _applied(df, text, "\0found", "array<struct<start:int,end:int,label:string>>", make, kind, lambda e: {"start": e[0], "end": e[1], "label": e[2]}, batch)
    kept = F.filter(F.col("`\0found`"), lambda e: e["label"].isin(*LABELS))
    named = F.transform(kept, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.substring(F.col(f"`{text}`"), e["start"] + 1, e["end"] - e["start"]).alias("text"), e["label"].alias("label")))
    return rows.select(*(F.col(f"`{c}`") for c in df.columns if c != out), named.cast(ENTITIES).alias(out))


def ocr_words(images: DataFrame, make: Callable, batch: int = 1) -> DataFrame:
    """Rows (image_id, content) to rows for `images.words_of`. A model gives (text, left, top, width, height, confidence) of each word."""
    names = ("text", "left", "top", "width", "height", "conf")
    kind = pa.list_(pa.struct([("text", pa.string()), *((n, pa.int32()) for n in names[1:5]), ("conf", pa.float64())]))
    rows = _applied(images.select("image_id", "content"), "content", "found", "array<struct<text:string,left:int,top:int,width:int,height:int,conf:double>>", make, kind, lambda w: dict(zip(names, w, strict=True)), batch)
    return rows.select("image_id", F.posexplode("found").alias("ord", "w")).select("image_id", "ord", "w.*")


def with_boxes(images: DataFrame, make: Callable, out: str = "faces", batch: int = 1) -> DataFrame:
    """Rows (image_id, content, ...) with `out`, an array of boxes. A model gives (left, top, width, height) of each."""
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("x1", "y1", "x2", "y2")]))
    return _applied(images, "content", out, f"array<{BOX}>", make, kind, lambda b: {"x1": b[0], "y1": b[1], "x2": b[0] + b[2], "y2": b[1] + b[3]}, batch)


def with_codes(images: DataFrame, make: Callable, out: str = "codes", batch: int = 1) -> DataFrame:
    """Rows (image_id, content, ...) with `out`, an array of arrays of corner points. A model gives lists of (x, y)."""
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    return _applied(images, "content", out, "array<array<struct<x:double,y:double>>>", make, kind, lambda c: [{"x": x, "y": y} for x, y in c], batch)
