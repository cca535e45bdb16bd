import numpy as np
import pytest
from pyspark.sql import functions as F

from quillveil.functions import layout
from quillveil.operators import images
from quillveil.policy import Policy
from quillveil.sources import png

WORDS = {
    "same_line": [("Name:", 50, 100, 40, 20), ("Asha", 100, 100, 50, 20), ("Rao", 160, 100, 50, 20)],
    "mrz_1": [("P<IND<<<<<", 50, 500, 400, 20)],
    "pan_header": [("INCOME TAX DEPARTMENT", 50, 50, 200, 20), ("Permanent Account Number Card", 50, 100, 300, 20)],
    "signature_above": [("John", 50, 25, 40, 15), ("Doe", 100, 25, 40, 15), ("Holder's", 50, 50, 60, 15), ("Signature", 115, 50, 60, 15)],
    "aadhaar_noisy": [("Goverment of mdia", 10, 10, 90, 10), ("Urique Identification Authonty", 10, 40, 200, 10), ("2345 6789 0123", 10, 80, 100, 10)],
    "aadhaar_clean": [("GOVERNMENT OF INDIA", 10, 10, 90, 10), ("Unique Identification Authority", 10, 40, 200, 10), ("2345 6789 0123", 10, 80, 100, 10)],
    "neg_1": [("This passport guidelines", 1, 1, 90, 10)],
    "neg_2": [("1234 5678 9012", 1, 1, 90, 10)],
    "neg_3": [("Account balance is ABCDE1234F", 1, 1, 90, 10)],
    "passport_2": [("REPUBLIC", 10, 10, 50, 10), ("OF", 65, 10, 20, 10), ("INDIA", 90, 10, 40, 10), ("PASSPORT", 10, 40, 80, 10), ("P<INDRAO<<ASHA<<<<", 10, 800, 300, 10), ("A1234567<8IND<<<<<", 10, 830, 300, 10)],
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, i, t, x, y, w, h, 90.0) for k, ws in WORDS.items() for i, (t, x, y, w, h) in enumerate(ws)]
    rows += [("same_line", 9, "faint", 1, 1, 9, 9, 39.9), ("same_line", 10, "  ", 1, 1, 9, 9, 90.0)]
    return images.words_of(spark.createDataFrame(rows, "image_id string, ord int, text string, left int, top int, width int, height int, conf double"))


def test_classification(pages):
    got = {r.image_id: (r.c.doc_type, r.c.confidence) for r in pages.select("image_id", layout.classify(F.col("raw")).alias("c")).collect()}
    assert got["aadhaar_noisy"] == got["aadhaar_clean"] == ("aadhaar", "high")
    assert got["passport_2"][0] == "passport" and got["pan_header"] == ("pan", "low")
    assert all(got[k] == ("unknown", "low") for k in ("neg_1", "neg_2", "neg_3", "same_line"))


def test_fields(pages):
    def boxes(image, kind):
        row = pages.where(F.col("image_id") == image).select(layout.fields(F.col("words"), F.lit(kind)).alias("f")).first()
        return [(f.field, tuple(f.box)) for f in row.f]

    assert ("name", (100, 100, 210, 120)) in boxes("same_line", "pan")
    assert ("mrz", (50, 500, 450, 520)) in boxes("mrz_1", "passport")
    assert sum(f == "mrz" for f, _ in boxes("passport_2", "passport")) == 2
    assert ("fallback_photo", (56, 58, 134, 102)) in boxes("pan_header", "pan") and ("fallback_signature", (170, 99, 305, 116)) in boxes("pan_header", "pan")
    assert ("signature", (50, 25, 140, 40)) in boxes("signature_above", "pan")


def test_merge_and_clip(spark):
    def run(rows, w, h):
        df = spark.createDataFrame([(rows,)], f"b array<{layout.BOX}>")
        return [tuple(b) for b in df.select(layout.merged(layout.clipped(F.col("b"), F.lit(w), F.lit(h))).alias("m")).first().m]

    assert run([(-10, -10, 50, 50), (15, 15, 80, 80), (200, 200, 250, 250), (210, 210, 240, 240), (500, 500, 400, 400)], 300, 300) == [(0, 0, 80, 80), (200, 200, 250, 250)]
    assert run([(0, 0, 10, 10), (20, 0, 30, 10), (4, 0, 26, 10)], 100, 100) == [(0, 0, 26, 10), (20, 0, 30, 10)]
    assert run([(0, 0, 10, 10), (4, 0, 26, 10), (20, 0, 30, 10)], 100, 100) == [(0, 0, 30, 10)]


def test_plan_masks_only_sure_documents(pages):
    face = F.array(layout.box(F.lit(250), F.lit(80), F.lit(280), F.lit(110)))
    code = F.array(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((1.5, 2.5), (9.9, 2.0)))))
    rows = pages.withColumn("width", F.lit(900)).withColumn("height", F.lit(900)).withColumn("faces", face).withColumn("codes", code)
    got = {r.image_id: r for r in images.plan(rows).collect()}
    assert got["pan_header"].photo_regions_masked == 0 and got["pan_header"].qr_codes_masked == 0
    assert got["aadhaar_clean"].photo_regions_masked == 1 and got["aadhaar_clean"].qr_codes_masked == 1 and got["aadhaar_clean"].qr_fallback_masked == 1
    assert all(r.faces_masked == 1 for r in got.values())
    off = {r.image_id: r for r in images.plan(rows, Policy.only("id_documents")).collect()}
    assert off["aadhaar_clean"].photo_regions_masked == 1 and off["aadhaar_clean"].faces_masked == 0 and not off["neg_1"].modified


def test_png_round_trip_and_mask():
    rng = np.random.default_rng(1)
    for channels in (1, 2, 3, 4):
        pixels = rng.integers(0, 256, (7, 5, channels), dtype=np.uint8)
        assert (png.decode(png.encode(pixels)) == pixels).all()
    white = png.encode(np.full((10, 10, 3), 255, np.uint8))
    black = (png.decode(png.masked(white, [(2, 3, 4, 5)])) == 0).all(axis=2)
    assert black.sum() == 9 and black[3:6, 2:5].all() and png.masked(white, []) == white
    with pytest.raises(ValueError):
        png.masked(b"garbage", [])
