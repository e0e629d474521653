"""Document files as rows: format detection, text and embedded links."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvloom.functions.text import first_match
from cvloom.sources.pdf import Pdf

try:
    import pymupdf
except ImportError:
    pymupdf = None

FORMATS = ("pdf", "docx")
SCHEMA = "path string, raw_text string, extra_urls array<string>, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def extension(path: Column) -> Column:
    """The suffix of a file name in lower case, without the dot; null if there is none."""
    return F.lower(first_match(path, r"\.([^./\\]+)$", 1))


def format_error(path: Column) -> Column:
    """Why a file of this name is not read; null if it is."""
    ext = extension(path)
    return F.when(ext.isNull(), "Could not determine the file format").when(~ext.isin(*FORMATS), F.concat(F.lit("Unsupported file format '."), ext, F.lit("'")))


# ---- DOCX -------------------------------------------------------------------------------------------


_IN_RUN = {_W + "tab": "\t", _W + "cr": "\n", _W + "br": "\n", _W + "noBreakHyphen": "-", _W + "ptab": "\t"}


def _paragraph(p) -> str:
    """Text of the runs of a paragraph and of its hyperlinks. What floats beside it (text boxes and their fallbacks) lies
    deeper inside of a run and does not belong to the body's text."""
    runs = [r for x in p for r in ([x] if x.tag == _W + "r" else x.iter(_W + "r") if x.tag == _W + "hyperlink" else ())]
    return "".join((x.text or "") if x.tag == _W + "t" else _IN_RUN.get(x.tag, "") for r in runs for x in r).strip()


def docx_text(data: bytes) -> str:
    """Non-empty body paragraphs, then, after all of them, the table rows with their non-empty cells joined."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
    if body is None:
        raise ValueError("no body")
    lines = [t for p in body.findall(_W + "p") if (t := _paragraph(p))]
    for tbl in body.findall(_W + "tbl"):
        above: list[str] = []
        for row in tbl.findall(_W + "tr"):
            cells: list[str] = []
            for cell in row.findall(_W + "tc"):
                props = cell.find(_W + "tcPr")
                span, merged = 1, None
                if props is not None:
                    g, merged = props.find(_W + "gridSpan"), props.find(_W + "vMerge")
                    span = int(g.get(_W + "val", "1")) if g is not None else 1
                text = "\n".join(_paragraph(p) for p in cell.findall(_W + "p")).strip()
                if merged is not None and merged.get(_W + "val") != "restart" and len(cells) < len(above):
                    text = above[len(cells)]  # a merged cell repeats in every row and column that it spans
                cells += [text] * span
            above = cells
            if kept := [c for c in cells if c]:
                lines.append("  |  ".join(kept))
    if not lines:
        raise ValueError("no text")
    return "\n".join(lines)


def docx_links(data: bytes) -> list[str]:
    """Targets of the hyperlink relationships of the document part."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    return [r.get("Target", "") for r in root.findall(_R + "Relationship") if r.get("Type", "").endswith("/hyperlink")]


# ---- PDF --------------------------------------------------------------------------------------------


def pdf_text(data: bytes) -> str:
    """Texts of the pages that have any, with a form feed between pages."""
    if pymupdf:
        with pymupdf.open(stream=data, filetype="pdf") as doc:
            pages = [p.get_text("text") for p in doc]
    else:
        pdf = Pdf(data)
        pages = [pdf.page_text(p) for p in pdf.pages()]
    kept = [p for p in pages if p.strip()]
    if not kept:
        raise ValueError("no text")
    return "\f\n".join(kept)


def pdf_links(data: bytes) -> list[str]:
    try:
        if pymupdf:
            with pymupdf.open(stream=data, filetype="pdf") as doc:
                return [u["uri"] for p in doc for u in p.get_links() if u.get("uri")]
        return Pdf(data).links()
    except Exception:  # noqa: BLE001 - links never make a file fail
        return []


def tidy_links(links: list[str]) -> list[str]:
    """Web links once each, in order, without blanks and closing slashes."""
    return list(dict.fromkeys(u.strip().rstrip("/") for u in links if u.lower().startswith(("http://", "https://"))))


def decode(path: str, data: bytes | None) -> tuple[str | None, list[str], str | None]:
    """(text, links, error) of a file. Nothing is raised: what goes wrong is the error of the row."""
    ext = path.rpartition("/")[2].rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    if ext not in FORMATS:
        return None, [], f"Unsupported file format '.{ext}'" if ext else "Could not determine the file format"
    links = tidy_links(pdf_links(data or b"") if ext == "pdf" else docx_links(data or b""))
    try:
        return (pdf_text if ext == "pdf" else docx_text)(data or b""), links, None
    except Exception as e:  # noqa: BLE001 - any damage to a file
        return None, links, f"Could not read {ext.upper()}: {e}"


def decode_files(files: DataFrame) -> DataFrame:
    """(path, raw_text, extra_urls, error) of rows (path, content), batch or stream; an `error` that a row has already stays. Each file is opened once, in the task
    that reads it; a broken or unknown one gives an error and null text, and the job goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(None, [], e) if e else decode(p or "", c) for p, c, e in zip(b["path"], b["content"], b["error"].where(b["error"].notna(), None))]
            yield pd.DataFrame({"path": b["path"], "raw_text": [g[0] for g in got], "extra_urls": [g[1] for g in got], "error": [g[2] for g in got]})

    known = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    return files.select("path", "content", known.alias("error")).mapInPandas(run, SCHEMA)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The document files below a folder, decoded."""
    return decode_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))
