"""Document files as rows: text, Word, Excel, PowerPoint and EPUB.

Files come from Spark's binaryFile source, so any file system Spark reads will do.
Office files are ZIP archives of XML and are read with the standard library in Arrow
batches; PDF pages need an optional library and are refused without it.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Any, NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EXTENSIONS, content_type, drop_page_noise

CELL_CHARS, NOTE_CHARS = 500, 2000
EXTRACTED = "text string, printed array<string>, chapters array<struct<start:bigint,chapter:bigint,title:string>>, outline array<struct<level:bigint,title:string,page:bigint>>, error string"
#: Encodings that are tried in turn.
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")


class Extracted(NamedTuple):
    """A text or else the texts of its pages as printed, where chapters begin (start, chapter, title), and bookmarks (level, title, page)."""

    text: str | None
    printed: list[str] = []
    chapters: list[tuple[int, int, str]] = []
    outline: list[tuple[int, str, int]] = []


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, kind, content) of the known files of one folder, not of those below it."""
    known = sorted(e[1:] for es in EXTENSIONS.values() for e in es)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*known)
    return files.where(wanted).select("path", name.alias("name"), content_type(F.col("path")).alias("kind"), "content")


def decode_text(data: bytes) -> str:
    """Bytes by the first encoding that takes them all."""
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 takes any bytes")


def plain_text(data: bytes) -> Extracted:
    return Extracted(decode_text(data))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _all(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if _local(x.tag) == name)


def _attribute(node: ElementTree.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), "")


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def word_text(data: bytes) -> Extracted:
    """Paragraphs of a docx, headings with # by level."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = []
        for p in _all(_xml(z, "word/document.xml"), "p"):
            said = "".join(x.text or "" for x in _all(p, "t"))
            style = next((_attribute(x, "val") for x in _all(p, "pStyle")), "")
            level = re.fullmatch(r"Heading(-?\d+)", style)
            if said.strip():
                out.append("#" * max(1, min(6, int(level[1]))) + " " + said if level else said)
    return Extracted("\n".join(out))


def _sheet_rows(z: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[list[str]]:
    for row in _all(_xml(z, part), "row"):
        cells: list[str] = []
        for c in _all(row, "c"):
            letters = re.match("[A-Z]+", c.get("r") or "")
            column = 0
            for letter in letters[0] if letters else "":
                column = column * 26 + ord(letter) - 64
            cells += [""] * (column - 1 - len(cells))
            value = next((x.text or "" for x in _all(c, "v")), "")
            if c.get("t") == "s" and value:
                value = shared[int(value)]
            elif c.get("t") == "inlineStr":
                value = "".join(x.text or "" for x in _all(c, "t"))
            cells.append(value[:CELL_CHARS])
        yield cells


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    resolve = lambda t: t[1:] if t.startswith("/") else posixpath.normpath(f"{folder}/{t}")
    return {_attribute(r, "Id"): resolve(_attribute(r, "Target")) for r in _xml(z, rels)}


def excel_text(data: bytes) -> Extracted:
    """Sheets under a heading each, cells of a row joined by bars, blank rows left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(_xml(z, "xl/sharedStrings.xml"), "si")]
        parts, out = _relations(z, "xl/workbook.xml"), []
        for sheet in _all(_xml(z, "xl/workbook.xml"), "sheet"):
            out.append(f"## 工作表: {sheet.get('name')}")
            out += [" | ".join(cells) for cells in _sheet_rows(z, parts[_attribute(sheet, "id")], shared) if any(c.strip() for c in cells)]
    return Extracted("\n".join(out))


def slides_text(data: bytes) -> Extracted:
    """Slides under a heading each: title, subtitle, other texts, tables, notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts, out = _relations(z, "ppt/presentation.xml"), []
        for i, ref in enumerate(_all(_xml(z, "ppt/presentation.xml"), "sldId"), 1):
            part = parts[next(v for k, v in ref.attrib.items() if k.endswith("}id"))]
            out.append(f"## 幻灯片 {i}")
            slide = _xml(z, part)
            for shape in (x for x in slide.iter() if _local(x.tag) in ("sp", "graphicFrame")):
                kind = next((_attribute(x, "type") for x in _all(shape, "ph")), "")
                if _local(shape.tag) == "graphicFrame":
                    out += [" | ".join("".join(t.text or "" for t in _all(cell, "t")) for cell in _all(row, "tc")) for row in _all(shape, "tr")]
                    continue
                said = "\n".join(x for x in ("".join(t.text or "" for t in _all(p, "t")) for p in _all(shape, "p")) if x.strip())
                if said:
                    out.append({"title": "# ", "ctrTitle": "# ", "subTitle": "### "}.get(kind, "") + said)
            for other in _relations(z, part).values():
                if "notesSlide" in other:
                    said = " ".join("".join(t.text or "" for t in _all(p, "t")) for s in _all(_xml(z, other), "sp") if any(_attribute(x, "type") == "body" for x in _all(s, "ph")) for p in _all(s, "p")).strip()
                    if said:
                        out.append("备注: " + said[:NOTE_CHARS])
    return Extracted("\n".join(out))


class _Lines(HTMLParser):
    """Collects the text lines of a page, headings with # by level; entities stay as written."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.parts: list[str] = []
        self.heading = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if re.fullmatch("h[1-6]", tag):
            self.heading = True
            self.parts.append(f"\n{'#' * int(tag[1])} ")
        elif not self.heading:
            self.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if re.fullmatch("h[1-6]", tag):
            self.heading = False
            self.parts.append("\n")
        elif not self.heading:
            self.parts.append(" ")

    def handle_data(self, data: str) -> None:
        self.parts.append(data)

    def handle_entityref(self, name: str) -> None:
        self.parts.append(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.parts.append(f"&#{name};")


def _html_lines(html: str) -> str:
    """As ``functions.text.html_to_text``, for XHTML inside an archive."""
    page = _Lines()
    page.feed(html)
    page.close()
    rows = (" ".join(row.split()) for row in "".join(page.parts).split("\n"))
    return "\n".join(filter(None, rows))


def epub_text(data: bytes) -> Extracted:
    """Chapters in spine order (navigation left out) with their offsets and titles."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        package = next(_attribute(x, "full-path") for x in _all(_xml(z, "META-INF/container.xml"), "rootfile"))
        opf, base = _xml(z, package), posixpath.dirname(package)
        items = {x.get("id"): x for x in _all(opf, "item")}
        resolve = lambda href: posixpath.normpath(posixpath.join(base, href))
        titles: dict[str, str] = {}
        for x in items.values():
            if x.get("media-type") == "application/x-dtbncx+xml":
                for point in _all(_xml(z, resolve(x.get("href"))), "navPoint"):
                    label, source = next(_all(point, "text")), next(_all(point, "content"))
                    titles.setdefault(resolve(_attribute(source, "src").split("#")[0]), (label.text or "").strip())
        texts, chapters, at = [], [], 0
        for ref in _all(opf, "itemref"):
            x = items.get(ref.get("idref"))
            if x is None or "nav" in (x.get("properties") or "").split() or "html" not in (x.get("media-type") or ""):
                continue
            said = _html_lines(z.read(resolve(x.get("href"))).decode("utf-8", "replace"))
            if said:
                chapters.append((at, len(chapters) + 1, titles.get(resolve(x.get("href")), "")))
                texts.append(said)
                at += len(said) + 2
    return Extracted("\n\n".join(texts), chapters=chapters)


def pdf_text(data: bytes) -> Extracted:
    """The texts of the pages as printed, and the bookmarks.

    A page that can't be read is empty, and bookmarks that can't be read, or that name no
    page, are left out; the text stays.
    """
    from pypdf import PdfReader  # optional

    reader = PdfReader(io.BytesIO(data))
    texts = []
    for page in reader.pages:
        try:
            texts.append(page.extract_text() or "")
        except Exception:  # the other pages are kept
            texts.append("")
    try:
        marks = list(_bookmarks(reader, reader.outline))
    except Exception:  # a broken outline must not cost the text
        marks = []
    return Extracted(None, texts, outline=marks)


def _bookmarks(reader: Any, nodes: list, level: int = 1) -> Iterator[tuple[int, str, int]]:
    """(level, title, page from 1) of bookmarks in order; a list holds those below the bookmark before it."""
    for node in nodes:
        if isinstance(node, list):
            yield from _bookmarks(reader, node, level + 1)
            continue
        page = reader.get_destination_page_number(node)
        title = (node.title or "").strip()
        if page is not None and page >= 0 and title:
            yield level, title, page + 1


READERS: dict[str, Callable[[bytes], Extracted]] = {"text": plain_text, "word": word_text, "excel": excel_text, "pptx": slides_text, "epub": epub_text, "pdf": pdf_text}


def extract(files: DataFrame) -> DataFrame:
    """(path, kind, text, pages, chapters, outline, error) of scanned files; a file that can't be read has an error.

    Printed footers go from a file's pages before the pages are joined by line ends and their offsets counted.
    """
    tables = {"chapters": ("start", "chapter", "title"), "outline": ("level", "title", "page")}
    struct = lambda names: pa.list_(pa.struct([(n, pa.string() if n == "title" else pa.int64()) for n in names]))
    kinds = {"path": pa.string(), "kind": pa.string(), "text": pa.string(), "printed": pa.list_(pa.string()), **{c: struct(names) for c, names in tables.items()}, "error": pa.string()}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found, error = READERS[kind](data), None
                except Exception as e:  # one bad file must not end the batch
                    found, error = Extracted(None), f"{type(e).__name__}: {e}"
                named = {c: [dict(zip(names, x, strict=True)) for x in getattr(found, c)] for c, names in tables.items()}
                rows.append({"path": path, "kind": kind, "text": found.text, "printed": found.printed, **named, "error": error})
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))

    chosen = files.where(F.col("kind").isin(*READERS)).select("path", "kind", "content")
    rows = chosen.mapInArrow(apply, f"path string, kind string, {EXTRACTED}").withColumn("_pages", F.transform("printed", drop_page_noise))
    before = lambda i: F.aggregate(F.slice("_pages", F.lit(1), i), F.lit(0).cast("bigint"), lambda at, x: at + F.length(x) + 1)
    pages = F.transform("_pages", lambda _, i: F.struct(before(i).alias("start"), (i + 1).cast("bigint").alias("page")))
    text = F.when(F.size("_pages") > 0, F.array_join("_pages", "\n")).otherwise(F.col("text"))
    return rows.select("path", "kind", text.alias("text"), pages.alias("pages"), "chapters", "outline", "error")
