"""Text out of single files.  Small per-file helpers, run inside tasks by ``lake.parse_files``.

Formats whose libraries are absent (PDF, images, audio, legacy slides) go to a
pluggable reader; without one the file gets an error row, never an exception.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from ..fixed_values import TEXT_ENCODINGS

_HIDDEN = ("script", "style", "noscript")


def decode(data: bytes) -> str:
    """First encoding that accepts the bytes."""
    for name in TEXT_ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1", errors="replace")


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.hidden.remove(tag)

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str) -> str:
    """Visible text with one space between pieces, blanks collapsed."""
    page = _Visible()
    page.feed(html)
    page.close()
    return re.sub(r"\s+", " ", " ".join(page.parts)).strip()


def _xml(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name))


def _local(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _runs(node) -> str:
    """Text of one paragraph: runs, tabs and line breaks."""
    marks = {"t": None, "tab": "\t", "br": "\n", "cr": "\n"}
    out = []
    for part in node.iter():
        kind = _local(part)
        if kind in marks:
            out.append((part.text or "") if kind == "t" else marks[kind])
    return "".join(out)


def docx_text(data: bytes) -> str:
    """Non-blank paragraphs, then table rows with cells joined by a bar."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(n for n in _xml(z, "word/document.xml") if _local(n) == "body")
    lines = [text for n in body if _local(n) == "p" and (text := _runs(n)).strip()]
    for table in (n for n in body if _local(n) == "tbl"):
        for row in (n for n in table if _local(n) == "tr"):
            cells = [n for n in row if _local(n) == "tc"]
            lines.append(" | ".join("\n".join(_runs(p) for p in c if _local(p) == "p").strip() for c in cells))
    return "\n".join(lines)


def _numbered(names, pattern: str) -> list[str]:
    found = [(int(m.group(1)), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def pptx_text(data: bytes) -> tuple[str, int]:
    """Slides in order, each under a ``[Slide n]`` line; slides without text are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml")
        pieces = []
        for number, name in enumerate(slides, 1):
            shapes = [n for n in _xml(z, name).iter() if _local(n) == "sp"]
            texts = ["\n".join(_runs(p) for p in shape.iter() if _local(p) == "p") for shape in shapes]
            texts = [t for t in texts if t]
            if texts:
                pieces.append(f"\n[Slide {number}]\n" + "\n".join(texts))
    return "\n".join(pieces), len(slides)


def epub_text(data: bytes) -> tuple[str, str | None]:
    """Chapters in reading order and the title."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = next(n.attrib["full-path"] for n in _xml(z, "META-INF/container.xml").iter() if _local(n) == "rootfile")
        package = _xml(z, root)
        folder = root.rsplit("/", 1)[0] + "/" if "/" in root else ""
        items = [n for n in package.iter() if _local(n) == "item" and "html" in n.attrib.get("media-type", "")]
        chapters = [html_text(decode(z.read(folder + n.attrib["href"]))) for n in items]
        title = next((n.text for n in package.iter() if _local(n) == "title"), None)
    return "\n\n".join(c for c in chapters if c), title


def xlsx_sheets(data: bytes, limit: int | None = None) -> dict[str, list[list[str | None]]]:
    """Rows of every sheet in workbook order; cells by column letter, gaps are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in (n for n in _xml(z, "xl/sharedStrings.xml") if _local(n) == "si"):
                shared.append("".join(t.text or "" for t in item.iter() if _local(t) == "t"))
        links = {n.attrib["Id"]: n.attrib["Target"] for n in _xml(z, "xl/_rels/workbook.xml.rels")}
        out = {}
        for sheet in (n for n in _xml(z, "xl/workbook.xml").iter() if _local(n) == "sheet"):
            ref = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            target = links[ref].lstrip("/")
            rows = []
            for row in (n for n in _xml(z, target if target.startswith("xl/") else f"xl/{target}").iter() if _local(n) == "row"):
                if limit is not None and len(rows) >= limit:
                    break
                rows.append(_cells(row, shared))
            out[sheet.attrib["name"]] = rows
    return out


def _cells(row, shared: list[str]) -> list[str | None]:
    out: list[str | None] = []
    for cell in (n for n in row if _local(n) == "c"):
        letters = re.match(r"[A-Z]+", cell.attrib.get("r", ""))
        at = len(out)
        if letters:
            at = 0
            for ch in letters.group(0):
                at = at * 26 + ord(ch) - 64
            at -= 1
        out += [None] * (at - len(out))
        value = next((n.text for n in cell if _local(n) == "v"), None)
        if cell.attrib.get("t") == "s" and value is not None:
            value = shared[int(value)]
        elif cell.attrib.get("t") == "inlineStr":
            value = "".join(t.text or "" for t in cell.iter() if _local(t) == "t")
        out.append(value)
    return out


def csv_rows(text: str) -> list[list[str]]:
    """Rows of delimited text; the separator is guessed only when commas do not split the lines."""
    lines = text.splitlines(keepends=True)
    separator = ","
    if lines and not any("," in line for line in lines[:30]):
        try:
            separator = csv.Sniffer().sniff("".join(lines[:30]), ";\t|").delimiter
        except csv.Error:
            pass
    return [row for row in csv.reader(io.StringIO(text), delimiter=separator) if row]
