"""Text of files: plain, office formats and, if a reader for it is installed, PDF.

Office files are zip archives of XML parts; their text elements are taken with the standard library.
"""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType, StructField, StructType

# Fixed names and patterns of the file formats.
DOCX_MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
DOCX_DEFAULT = "word/document.xml"
CONTENT_TYPES = "[Content_Types].xml"
OPEN_DOCUMENT = "content.xml"

_OVERRIDE = re.compile(r"<Override\b[^>]*>")
_SLIDE = re.compile(r"ppt/slides/slide.*\.xml")
_BAD_BYTES = re.compile("�+")


class ExtractError(ValueError):
    """A file that can't be read as what its extension says."""


def _archive(data: bytes, what: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ExtractError(f"{what}: not a zip archive") from e


def _part(z: zipfile.ZipFile, name: str, what: str) -> str:
    try:
        return z.read(name).decode("utf-8", "replace")
    except KeyError as e:
        raise ExtractError(f"{what}: no part {name}") from e


def _texts(xml: str, *tags: str) -> list[str]:
    """Trimmed contents of the elements of each tag in turn that hold text alone."""
    return [t.strip() for tag in tags for t in re.findall(rf"<{tag}[^>]*>([^<]*)</{tag}>", xml)]


def plain(data: bytes) -> str:
    """Bytes as UTF-8; each run of bad bytes becomes one replacement character."""
    return _BAD_BYTES.sub("�", data.decode("utf-8", "replace"))


def docx(data: bytes) -> str:
    z, name = _archive(data, "docx"), DOCX_DEFAULT
    if CONTENT_TYPES in z.namelist():
        for tag in _OVERRIDE.findall(_part(z, CONTENT_TYPES, "docx")):
            given = dict(re.findall(r'(\w+)="([^"]*)"', tag))
            if given.get("ContentType") == DOCX_MAIN and given.get("PartName"):
                name = given["PartName"].removeprefix("/")
                break
    return " ".join(_texts(_part(z, name, "docx"), "w:t")).strip()


def pptx(data: bytes) -> str:
    z = _archive(data, "pptx")
    slides = [n for n in z.namelist() if _SLIDE.fullmatch(n)]
    return " ".join(t for n in slides for t in _texts(_part(z, n, "pptx"), "a:t")).strip()


def odp(data: bytes) -> str:
    return " ".join(_texts(_part(_archive(data, "odp"), OPEN_DOCUMENT, "odp"), "text:p", "text:span", "text:h")).strip()


def ods(data: bytes) -> str:
    return " ".join(_texts(_part(_archive(data, "ods"), OPEN_DOCUMENT, "ods"), "text:p", "text:span")).strip()


def xlsx(data: bytes) -> str:
    """All sheets in the workbook's order: cells between tabs, rows on lines."""
    from xml.etree import ElementTree

    z = _archive(data, "xlsx")
    names = set(z.namelist())
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    read = lambda n: ElementTree.fromstring(z.read(n))
    text_of = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    shared = [text_of(s) for s in read("xl/sharedStrings.xml") if local(s) == "si"] if "xl/sharedStrings.xml" in names else []
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        targets = {r.get("Id"): r.get("Target", "") for r in read("xl/_rels/workbook.xml.rels")}
        ids = [v for s in read("xl/workbook.xml").iter() if local(s) == "sheet" for k, v in s.attrib.items() if k.endswith("}id")]
        listed = [t.removeprefix("/") if t.startswith("/") else f"xl/{t}" for t in (targets.get(i, "") for i in ids) if t]
        sheets = [n for n in listed if n in names] or sheets
    if not sheets:
        raise ExtractError("xlsx: no sheets")

    def cells(row) -> list[str]:
        out: list[str] = []
        for c in (c for c in row if local(c) == "c"):
            letters = re.match(r"[A-Z]+", c.get("r") or "")
            place = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(out)
            out += [""] * (place - len(out))
            value = next((v.text or "" for v in c if local(v) == "v"), "")
            out.append(shared[int(value)] if c.get("t") == "s" and value else text_of(c) if c.get("t") == "inlineStr" else value)
        return out

    return "\n".join("\t".join(cells(row)) for n in sheets for row in read(n).iter() if local(row) == "row").strip()


def pdf(data: bytes) -> str:
    """Page texts on lines. Needs pypdf; without it a clear error."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ExtractError("pdf: reading PDF files needs the package pypdf, or an extractor of your own") from e
    return "\n".join(t for p in PdfReader(io.BytesIO(data)).pages if (t := p.extract_text()) is not None)


EXTRACTORS = {"pdf": pdf, "docx": docx, "odt": docx, "rtf": docx, "xlsx": xlsx, "pptx": pptx, "odp": odp, "ods": ods}


def extract_bytes(data: bytes, extension: str, extractors: dict | None = None) -> str:
    """Text of a file's bytes by its extension, with or without dot; unknown extensions are plain text."""
    return (EXTRACTORS | (extractors or {})).get(extension.lower().lstrip("."), plain)(data)


def extracted(content: Column, extension: Column, extractors: dict | None = None) -> Column:
    """struct<text, error> of file contents: one of the two is null."""
    kind = StructType([StructField("text", StringType()), StructField("error", StringType())])

    @arrow_udf(kind)
    def run(data: pa.Array, ext: pa.Array) -> pa.Array:
        out = []
        for d, e in zip(data.to_pylist(), ext.to_pylist()):
            try:
                out.append({"text": None if d is None else extract_bytes(d, e or "", extractors), "error": None})
            except Exception as x:  # noqa: BLE001 - one broken file must not stop the others
                out.append({"text": None, "error": str(x)})
        return pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))

    return run(content, extension)


def plain_text(content: Column) -> Column:
    """The same as :func:`plain` without Python: for plain files only."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�+", "�")
