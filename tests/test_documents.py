import numpy as np
from pyspark.sql import functions as F

from quillveil.operators import evaluate
from quillveil.plans.documents import redact_documents, register
from quillveil.sources import docx, png, protocol
from quillveil.streaming import redact as streaming


def _files(spark, made):
    return spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in made.items()], "path string, length long, content binary")


def test_documents(spark):
    nested = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell a@b.com</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner 10.0.0.1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    image = png.encode(np.full((9, 9, 3), 255, np.uint8))
    made = {
        "pii.docx": docx.package([["Mail ", "x@exa", "mple.com", " now"], ["  "], ["PAN ABCDE1234F"]], {"word/media/a.png": image}, {"creator": "Someone", "title": "Secret"}, nested, ["Header 1.2.3.4"]),
        "clean.docx": docx.package([["This offer follows SEBI Regulations."]]),
        "corrupt.docx": b"garbage",
        "bad_image.docx": docx.package([["a@b.com"]], {"word/media/x.png": b"junk"}),
        "empty.docx": b"",
        "test.txt": b"abc",
    }
    boxes = spark.createDataFrame([("pii.docx", "word/media/a.png", [(1, 1, 3, 3)])], "path string, zip_name string, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
    got = {r.path: r for r in redact_documents(_files(spark, made), boxes=boxes).collect()}
    assert {p for p, r in got.items() if r.status == "failed"} == {"corrupt.docx", "bad_image.docx", "empty.docx", "test.txt"}
    assert all(r.output is None for r in got.values() if r.status == "failed") and got["corrupt.docx"].message.startswith("Could not open DOCX file")
    row = got["pii.docx"]
    assert (row.paragraphs_scanned, row.tables_found, row.images_found, row.text_redactions, row.images_modified) == (5, 1, 1, 5, 1)
    out = {p[3]: p[4] for p in docx.paragraphs_of(bytes(row.output))}
    assert set(out) == {"body:para0", "body:para2", "table0:row0:cell0:para0", "table0:row0:cell0:nested_table0:row0:cell0:para0", "header0:para0"}
    text = "\n".join("".join(r) for r in out.values())
    assert not any(x in text for x in ("x@exa", "ABCDE1234F", "a@b.com", "10.0.0.1", "1.2.3.4")) and "Mail " in text and " now" in text
    import io
    import zipfile

    core = zipfile.ZipFile(io.BytesIO(bytes(row.output))).read(docx.CORE)
    assert b"Someone" not in core and b"Secret" not in core
    assert (png.decode(docx.media_of(bytes(row.output))[0][1])[1:4, 1:4] == 0).all()
    assert got["clean.docx"].text_redactions == 0


def test_images_of_other_formats_go_through_a_codec_of_ones_own(spark):
    def make():
        def masked(content, areas):
            if not content.startswith(b"RAW"):
                raise RuntimeError("no such format")
            return content if b"stuck" in content else content + bytes(len(areas))

        return masked

    made = {f"{n}.docx": docx.package([["a@b.com"]], {"word/media/a.jpeg": c}) for n, c in (("good", b"RAW1"), ("plain", b"RAW1"), ("stuck", b"RAWstuck"), ("alien", b"GIF"))}
    areas = [(f"{n}.docx", "word/media/a.jpeg", [(1, 1, 3, 3), (2, 2, 4, 4)]) for n in ("good", "stuck")]
    boxes = spark.createDataFrame(areas, "path string, zip_name string, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
    got = {r.path: r for r in redact_documents(_files(spark, made), boxes=boxes, codec=make).collect()}
    assert {p: r.message for p, r in got.items() if r.status == "failed"} == {"stuck.docx": "Could not mask image", "alien.docx": "Could not decode image: no such format"}
    assert [(docx.media_of(bytes(got[p].output))[0][1], got[p].images_modified) for p in ("good.docx", "plain.docx")] == [(b"RAW1\0\0", 1), (b"RAW1", 0)]
    assert all(r.status == "failed" for r in redact_documents(_files(spark, made), boxes=boxes).collect())


def _repacked(content, change):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as a, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as b:
        for item in a.infolist():
            b.writestr(item.filename, change(item.filename, a.read(item.filename)))
    return out.getvalue()


def test_damaged_packages_fail_alone(spark):
    whole = docx.package([["a@b.com"], ["plain"]], {"word/media/a.png": png.encode(np.zeros((30, 30, 3), np.uint8))}, {"title": "Secret"})
    encrypted = bytearray(whole)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        i = encrypted.find(mark)
        while i >= 0:
            encrypted[i + at] |= 1
            i = encrypted.find(mark, i + 4)
    at = whole.find(b"word/media/a.png") + len("word/media/a.png")
    made = {
        "good.docx": whole,
        "core.docx": _repacked(whole, lambda n, d: b"<broken" if n == docx.CORE else d),
        "encrypted.docx": bytes(encrypted),
        "truncated.docx": whole[: len(whole) // 2],
        "media.docx": whole[: at + 4] + b"\xff" * 8 + whole[at + 12 :],
        "xml.docx": _repacked(whole, lambda n, d: d[:-9] if n == docx.BODY else d),
    }
    got = {r.path: r for r in redact_documents(_files(spark, made)).collect()}
    assert {p for p, r in got.items() if r.status == "done"} == {"good.docx"}
    assert all(r.message and r.output is None for p, r in got.items() if p != "good.docx")


def test_tabs_and_breaks_survive_as_elements(spark):
    content = docx.package([], body="<w:p><w:r><w:t>Mail a@b.com</w:t><w:tab/><w:t>now</w:t><w:br/><w:t>or later</w:t></w:r></w:p>")
    row = redact_documents(_files(spark, {"a.docx": content})).first()
    (paragraph,) = docx.paragraphs_of(bytes(row.output))
    assert paragraph[4][0].startswith("Mail ") and paragraph[4][0].endswith("\tnow\nor later") and "a@b.com" not in paragraph[4][0]
    import io
    import zipfile

    xml = zipfile.ZipFile(io.BytesIO(bytes(row.output))).read(docx.BODY)
    assert xml.count(b"<w:tab") == 1 and xml.count(b"<w:br") == 1


def test_unused_prefixes_survive():
    source = b'<w:document xmlns:w="' + docx.W.encode() + b'" xmlns:w14="urn:x" xmlns:mc="urn:mc" mc:Ignorable="w14"><w:body><w:p><w:r><w:t>a</w:t></w:r></w:p></w:body></w:document>'
    from xml.etree import ElementTree as ET

    again = docx._serialized(ET.fromstring(source), source)
    assert b'xmlns:w14="urn:x"' in again and b"<w:t>a</w:t>" in again
    ET.fromstring(again)


def test_table_function(spark):
    register(spark)
    _files(spark, {"a.docx": docx.package([["hello"]])}).createOrReplaceTempView("files")
    assert [r.location for r in spark.sql("SELECT t.location FROM files, LATERAL docx_paragraphs(content) t").collect()] == ["body:para0"]


def test_stream_protocol(spark):
    df = spark.createDataFrame([(bytearray(b'PROGRESS:{"stage":"x"}\nMETRICS:{"paragraphs_scanned":3}\n\n---FILE---\nPK\x00\xff'),), (bytearray('ERROR:{"error":"bäd"}\n'.encode()),), (bytearray(b"hm"),)], "raw binary")
    a, b, c = [r.p for r in df.select(protocol.parsed(F.col("raw")).alias("p")).collect()]
    assert a.metrics.paragraphs_scanned == 3 and bytes(a.file) == b"PK\x00\xff" and a.error is None
    assert b.error == "bäd" and b.file is None and c.error == "Stream missing file marker"


def test_metrics(spark):
    def score(pred, truth):
        kind = "array<struct<start:int,end:int,category:string>>"
        rows = evaluate.metrics(spark.createDataFrame([(pred, truth)], f"predicted {kind}, truth {kind}")).collect()
        return {r.category: (r.tp, r.fp, r.fn) for r in rows}, {r.category: (r.precision, r.recall, r.f1) for r in rows}

    assert score([(0, 5, "a")], [(3, 8, "a")])[0]["a"] == (1, 0, 0)
    assert score([(0, 5, "a")], [(5, 8, "a")])[0]["a"] == (0, 1, 1)
    assert score([(0, 5, "a")], [(0, 5, "b")])[0] == {"a": (0, 1, 0), "b": (0, 0, 1), "OVERALL": (0, 1, 1)}
    assert score([(0, 9, "a")], [(0, 3, "a"), (4, 9, "a")])[0]["a"] == (1, 0, 1)
    assert score([], [(0, 3, "a")])[1]["a"] == (0.0, 0.0, 0.0)
    row = spark.range(1).select(evaluate.nth_span(F.lit("ab ab ab"), F.lit("ab"), F.lit(2)).alias("s"), evaluate.nth_span(F.lit("ab"), F.lit("ab"), F.lit(2)).alias("n")).first()
    assert (row.s.start, row.s.end) == (3, 5) and row.n is None


def test_stream_equals_batch(spark, tmp_path):
    from quillveil.operators.detect import redact

    folder = tmp_path / "in"
    spark.createDataFrame([(1, "a@b.com"), (2, "nothing"), (3, None)], "id int, text string").write.parquet(str(folder / "texts.parquet"))
    (stream := streaming.start(spark.readStream.schema("id int, text string").parquet(str(folder / "texts.parquet")), str(tmp_path / "out"), str(tmp_path / "state"))).awaitTermination()
    assert stream.exception() is None
    got = {r.id: r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.id: r.redacted for r in redact(spark.read.parquet(str(folder / "texts.parquet"))).collect()}


def test_stream_reads_a_file_or_a_folder_of_files(spark, tmp_path):
    from quillveil import catalogue

    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(("at 10.0.0.1", "nothing", None, "10.0.0.2, 10.0.0.3"))], "doc_id long, text string, lang string")
    rows.repartition(3).write.parquet(str(tmp_path / "parts" / "documents.parquet"))
    rows.write.partitionBy("lang").parquet(str(tmp_path / "by_lang" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (file,) = (tmp_path / "one").glob("part-*.parquet")
    file.rename(tmp_path / "one" / "documents.parquet")
    for name in ("parts", "by_lang", "one"):
        got, want = ({tuple(r) for r in catalogue.queries()[q](spark, str(tmp_path / name)).collect()} for q in ("stream_redact_available_now", "redact_text"))
        assert got == want and {r[0] for r in got} == {0, 3}, name
    rows.where("false").write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert catalogue.queries()["stream_redact_available_now"](spark, str(tmp_path / "empty")).collect() == []


def test_scored_run(spark):
    from quillveil.plans import evaluation

    got = {(r.backend, r.category): (r.tp, r.fp, r.fn) for r in evaluation.run(evaluation.cases(spark)).collect()}
    assert got["patterns", "OVERALL"] == (8, 0, 2) and got["rules", "OVERALL"] == (10, 0, 0)


def test_adapters(spark):
    from quillveil.operators.detect import detect
    from quillveil.sources import adapters

    def _tagger():
        return lambda texts: [[(i, i + 4, "ORG"), (0, 1, "DATE")] if (i := t.find("Acme")) >= 0 else [] for t in texts]

    def _reader():
        return lambda images: [[("Hi", 1, 2, 3, 4, 90.0)] * len(x) for x in images]

    df = spark.createDataFrame([(1, "Works at Acme now"), (2, None), (3, "nothing")], "entities int, text string")
    rows = adapters.with_entities(df.withColumnRenamed("entities", "id"), _tagger)
    found = {r.id: [(d.category, d.value) for d in r.detections] for r in detect(rows, found="entities").collect()}
    assert found == {1: [("company", "Acme")], 2: [], 3: []}
    images = spark.createDataFrame([("a", bytearray(b"xx")), ("b", bytearray(b"")), ("c", None)], "image_id string, content binary")
    assert [(r.image_id, r.ord, r.left, r.conf) for r in adapters.ocr_words(images, _reader).collect()] == [("a", 0, 1, 90.0), ("a", 1, 1, 90.0)]
    boxes = adapters.with_boxes(images, lambda: lambda xs: [[(1, 2, 3, 4)] for _ in xs]).collect()
    assert [[tuple(b) for b in r.faces] for r in boxes] == [[(1, 2, 4, 6)], [(1, 2, 4, 6)], []]
    codes = adapters.with_codes(images, lambda: lambda xs: [[[(1.5, 2.0), (3.0, 4.0)]] for _ in xs]).collect()
    assert codes[0].codes[0][1].x == 3.0 and codes[2].codes == []
