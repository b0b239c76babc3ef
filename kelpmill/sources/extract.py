"""Text from files: HTML, PDF, DOCX, XLSX, PPTX, HWPX and plain text, chosen by extension."""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_BYTES, SHEET_BYTES = 512 * 1024, 200 * 1024
TRUNCATED = "\n[content truncated]"


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs) -> None:
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style", "noscript") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data) -> None:
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_text(data: bytes) -> str:
    """Trimmed text nodes, one a line, without scripts and styles."""
    p = _Text()
    p.feed(re.sub("\r\n?", "\n", data.decode("utf-8", "replace")))  # as HTML parsers read line ends
    p.close()
    return "\n".join(p.parts)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraphs(xml: bytes) -> str:
    """Text of t elements, a line end after each p."""
    out = []
    for event, e in ElementTree.iterparse(io.BytesIO(xml), events=("start", "end")):
        if event == "end" and _local(e.tag) == "t" and e.text:
            out.append(e.text)
        elif event == "end" and _local(e.tag) == "p":
            out.append("\n")
    return "".join(out).strip()


def docx_text(data: bytes) -> str:
    """S08."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _paragraphs(z.read("word/document.xml"))


def pptx_text(data: bytes) -> str:
    """Slides in the order of their file names, as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
        return "\n\n".join(f"--- Slide {i} ---\n{_paragraphs(z.read(n))}" for i, n in enumerate(names, 1))


def hwpx_text(data: bytes) -> str:
    """Sections in numeric order, broken ones left out; a file without any is broken."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"Contents/section(\d+)\.xml", n)))
        if not found:
            raise KeyError("Contents")
        texts = []
        for _, name in found:
            try:
                texts.append(_paragraphs(z.read(name)))
            except ElementTree.ParseError:
                continue
        return "\n".join(t for t in texts if t)


def xlsx_text(data: bytes) -> str:
    """A heading and tab-separated rows for each sheet; empty rows and sheets fall away."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        names = [e.get("name") for e in book.iter() if _local(e.tag) == "sheet"]
        out = []
        for i, name in enumerate(names, 1):
            part, rows = f"xl/worksheets/sheet{i}.xml", []
            if part not in z.namelist():
                continue
            for row in (e for e in ElementTree.fromstring(z.read(part)).iter() if _local(e.tag) == "row"):
                cells = []
                for c in row:
                    value = next((v.text or "" for v in c.iter() if _local(v.tag) in ("v", "t")), "")
                    if c.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                        value = shared[int(value)]
                    cells.append(re.sub(r"[\t\r\n]+", " ", value))
                if any(x.strip() for x in cells):
                    rows.append("\t".join(cells).rstrip())
            if rows:
                out.append(f"##SHEET {name}\n" + "\n".join(rows))
        return cut("\n\n".join(out), SHEET_BYTES)


def pdf_text(data: bytes) -> str:
    """The text layer, where the external tool is there; too little text counts as none."""
    if not shutil.which("pdftotext"):
        return ""
    done = subprocess.run(["pdftotext", "-", "-"], input=data, capture_output=True, timeout=60, check=False)
    text = done.stdout.decode("utf-8", "replace").strip()
    return text if len(text) >= 16 else ""


def plain_text(data: bytes) -> str:
    return cut(data.decode("utf-8", "replace"), TEXT_BYTES)


EXTRACTORS = {"html": html_text, "htm": html_text, "pdf": pdf_text, "docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text, "hwpx": hwpx_text}


def cut(text: str, most: int) -> str:
    """at most so many bytes, at a character, with a mark."""
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + TRUNCATED


def clean(text: str) -> str:
    """F17."""
    return re.sub(r"\n{3,}", "\n\n", text.replace("\x00", " "))


def extract(data: bytes | None, path: str) -> str | None:
    """Null for broken files; unknown extensions count as text."""
    if data is None:
        return None
    try:
        return clean(EXTRACTORS.get(path.rpartition(".")[2].lower(), plain_text)(data))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, subprocess.SubprocessError):
        return None


def _extracted(data: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([extract(bytes(d) if d is not None else None, p) for d, p in zip(data, paths)], dtype=object)


def extracted(data: Column, path: Column) -> Column:
    return F.pandas_udf(_extracted, "string")(data, path)
