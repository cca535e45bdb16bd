"""DOCX packages: paragraphs and media as rows, and the rewriting of packages."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
MEDIA = "word/media/"
BODY = "word/document.xml"
CORE = "docProps/core.xml"
#: Local names of the core properties that are emptied.
PROPERTIES = ("creator", "lastModifiedBy", "description", "category", "subject", "title", "keywords", "comments")
MOST_BYTES = 15 * 1024 * 1024
PARAGRAPHS = "path string, part string, part_ord int, para_id int, location string, runs array<string>"
#: What a damaged, encrypted or oddly packed file makes its readers raise.
DAMAGE = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, ET.ParseError, KeyError, IndexError, ValueError, OSError, RuntimeError, EOFError)
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"


def _tag(name: str) -> str:
    return f"{{{W}}}{name}"


def files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, length, content) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def validated(rows: DataFrame) -> DataFrame:
    """rows with `error`: null for a file that may be read, else why not."""
    wrong = F.when(~F.lower("path").endswith(".docx"), "Only .docx files are accepted").when(F.col("length") == 0, "File is empty").when(F.col("length") > MOST_BYTES, "File is larger than 15 MB")
    return rows.withColumn("error", wrong)


def run_text(run: ET.Element) -> str:
    out = []
    for x in run:
        if x.tag == _tag("t"):
            out.append(x.text or "")
        elif x.tag == _tag("tab"):
            out.append("\t")
        elif x.tag in (_tag("br"), _tag("cr")):
            out.append("\n")
        elif x.tag == _tag("noBreakHyphen"):
            out.append("-")
    return "".join(out)


def _blocks(parent: ET.Element, prefix: str, table_name: str) -> Iterator[tuple[str, ET.Element]]:
    """Location and element of the paragraphs of a container, then those of its tables, depth first."""
    for i, p in enumerate(parent.findall(_tag("p"))):
        yield f"{prefix}para{i}", p
    for t, table in enumerate(parent.findall(_tag("tbl"))):
        yield from _table(table, f"{prefix}{table_name}{t}:")


def _table(table: ET.Element, prefix: str) -> Iterator[tuple[str, ET.Element]]:
    for r, row in enumerate(table.findall(_tag("tr"))):
        for c, cell in enumerate(row.findall(_tag("tc"))):
            yield from _blocks(cell, f"{prefix}row{r}:cell{c}:", "nested_table")


def _references(package: zipfile.ZipFile, root: ET.Element) -> Iterator[tuple[str, int, str]]:
    """Kind, section and part of each default header and footer; a part that sections share comes once."""
    try:
        rels = ET.fromstring(package.read("word/_rels/document.xml.rels"))
    except KeyError:
        return
    targets = {x.get("Id"): x.get("Target", "") for x in rels.iter(f"{{{RELS}}}Relationship")}
    seen = set()
    for kind in ("header", "footer"):
        for s, section in enumerate(root.iter(_tag("sectPr"))):
            for ref in section.findall(_tag(f"{kind}Reference")):
                part = "word/" + targets.get(ref.get(f"{{{R}}}id"), "").removeprefix("/word/")
                if ref.get(_tag("type"), "default") == "default" and part not in seen and part in package.namelist():
                    seen.add(part)
                    yield kind, s, part


def paragraphs_of(content: bytes) -> Iterator[tuple[str, int, int, str, list[str]]]:
    """part, part_ord, para_id (its number among the part's paragraphs), location and runs: body, tables, headers, footers.

    Blank paragraphs are left out but counted. Anything unreadable raises ValueError.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            root = ET.fromstring(package.read(BODY))
            body = root.find(_tag("body"))
            if body is None:
                raise ValueError("no body")
            parts = [(BODY, root, list(_blocks(body, "body:", "table")))]
            parts += [(part, top, list(_blocks(top, f"{kind}{s}:", "table"))) for kind, s, part in _references(package, root) for top in [ET.fromstring(package.read(part))]]
    except DAMAGE as e:
        raise ValueError(f"Could not open DOCX file: {e}") from None
    for n, (part, top, rows) in enumerate(parts):
        number = {id(p): i for i, p in enumerate(top.iter(_tag("p")))}
        for location, p in rows:
            runs = [run_text(r) for r in p.findall(_tag("r"))]
            if "".join(runs).strip():
                tabled = location.startswith("body:table")
                yield part, 2 * n + tabled, number[id(p)], location.removeprefix("body:") if tabled else location, runs


def paragraphs(rows: DataFrame) -> DataFrame:
    """Rows (path, content) to PARAGRAPHS and `error`; a file that cannot be read gives one row with its error."""

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(path, *p, None) for p in paragraphs_of(content)]
                except ValueError as e:
                    out.append((path, None, None, None, None, None, str(e)))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "part", "part_ord", "para_id", "location", "runs", "error"])

    return rows.select("path", "content").mapInArrow(run, PARAGRAPHS + ", error string")


def media_of(content: bytes) -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        return [(n, package.read(n)) for n in package.namelist() if n.startswith(MEDIA) and not n.endswith("/")]


def media(rows: DataFrame) -> DataFrame:
    """Rows (path, content) of packages to rows (path, zip_name, content, error) of their images.

    A package whose images cannot all be read gives one row with its error.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found, error = media_of(content), None
                except DAMAGE as e:
                    found, error = [(None, None)], f"Could not read the images: {e}"
                columns = [pa.array([path] * len(found), pa.string()), pa.array([n for n, _ in found], pa.string()), pa.array([b for _, b in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([error] * len(found), pa.string())], names=["path", "zip_name", "content", "error"])

    return rows.select("path", "content").mapInArrow(run, "path string, zip_name string, content binary, error string")


def _serialized(root: ET.Element, source: bytes) -> bytes:
    """The part with every namespace prefix of its source, used or not: other attributes may name them."""
    spaces = dict(pair for _, pair in ET.iterparse(io.BytesIO(source), events=["start-ns"]))
    for prefix, uri in spaces.items():
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    text = ET.tostring(root, encoding="unicode")
    head, rest = text.split(">", 1)
    closing = "/" if head.endswith("/") else ""
    head = head.removesuffix("/")
    missing = "".join(f' xmlns:{p}="{u}"' for p, u in spaces.items() if p and f"xmlns:{p}=" not in head)
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + head + missing + closing + ">" + rest).encode()


def _set_run(run: ET.Element, text: str) -> None:
    for x in list(run):
        if x.tag in (_tag("t"), _tag("tab"), _tag("br"), _tag("cr"), _tag("noBreakHyphen")):
            run.remove(x)
    for piece in re.split(r"([\t\n])", text):
        if piece in ("\t", "\n"):
            ET.SubElement(run, _tag("tab" if piece == "\t" else "br"))
        elif piece:
            t = ET.SubElement(run, _tag("t"))
            t.text = piece
            t.set(_SPACE, "preserve")


def patched(content: bytes, runs: list[tuple[str, int, int, str]], images: dict[str, bytes] | None = None) -> bytes:
    """The package with run texts (part, para_id, run_index, text) and images replaced and core properties emptied.

    Members keep their order; each paragraph is written once.
    """
    images, by_part = images or {}, {}
    for part, para, index, text in runs:
        by_part.setdefault(part, []).append((para, index, text))
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as source, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as sink:
        for item in source.infolist():
            data = images.get(item.filename, source.read(item.filename))
            if item.filename in by_part:
                root = ET.fromstring(data)
                all_paragraphs = list(root.iter(_tag("p")))
                for para, index, text in by_part[item.filename]:
                    _set_run(all_paragraphs[para].findall(_tag("r"))[index], text)
                data = _serialized(root, data)
            elif item.filename == CORE:
                root = ET.fromstring(data)
                for x in root.iter():
                    if x.tag.rpartition("}")[2] in PROPERTIES:
                        x.text = ""
                data = _serialized(root, data)
            sink.writestr(item, data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def package(paragraphs: list[list[str]], images: dict[str, bytes] | None = None, properties: dict[str, str] | None = None, body: str = "", header: list[str] | None = None) -> bytes:
    """A small package, for tests and examples: paragraphs of runs, further body XML, images, core properties, a header."""
    from xml.sax.saxutils import escape

    one = lambda runs: "<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{escape(r)}</w:t></w:r>' for r in runs) + "</w:p>"
    section = f'<w:sectPr><w:headerReference w:type="default" r:id="rId9" xmlns:r="{R}"/></w:sectPr>' if header else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>')
        z.writestr(BODY, f'<?xml version="1.0"?><w:document xmlns:w="{W}"><w:body>{"".join(map(one, paragraphs))}{body}{section * 2}</w:body></w:document>')
        if header:
            z.writestr("word/_rels/document.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{RELS}"><Relationship Id="rId9" Type="{R}/header" Target="header1.xml"/></Relationships>')
            z.writestr("word/header1.xml", f'<?xml version="1.0"?><w:hdr xmlns:w="{W}">{one(header)}</w:hdr>')
        if properties is not None:
            fields = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in properties.items())
            z.writestr(CORE, f'<?xml version="1.0"?><cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">{fields}</cp:coreProperties>')
        for name, data in (images or {}).items():
            z.writestr(name, data)
    return out.getvalue()
