"""EPUB containers as ordered chapters of paragraphs.

A container is one row, as the binary-file source gives it: the spine, whose
order is that of reading, and the documents are inside one archive, so a
book is the unit of work and its size bounds a task's memory.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.html import paragraphs_of

#: A document of pictures with no heading and at most so many words is an art plate.
PLATE_WORDS = 10
SCHEMA = "path string, title string, chapter_idx int, chapter_title string, seq int, tag string, text string"


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the containers in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")


def spine(book: zipfile.ZipFile) -> tuple[str | None, list[str]]:
    """The book's title and the names of its documents in reading order."""
    root = ElementTree.fromstring(book.read("META-INF/container.xml")).find(".//{*}rootfile")
    if root is None:
        raise ValueError("the container names no package")
    package = root.attrib["full-path"]
    tree = ElementTree.fromstring(book.read(package))
    files = {i.attrib["id"]: posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(i.attrib["href"]))) for i in tree.findall(".//{*}manifest/{*}item")}
    title = tree.findtext(".//{http://purl.org/dc/elements/1.1/}title")
    return title and " ".join(title.split()), [files[i.attrib["idref"]] for i in tree.findall(".//{*}spine/{*}itemref")]


def chapters_of(content: bytes) -> list[tuple]:
    """(title, chapter_idx, chapter_title, seq, tag, text) of every paragraph.

    A document with a heading starts a chapter, one without continues the chapter
    before it, or starts one without a title where there is none; art plates are dropped.
    """
    out: list[tuple] = []
    at, seq, heading = -1, 0, None
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        title, names = spine(book)
        for name in names:
            html = book.read(name).decode("utf-8", "replace")
            blocks = paragraphs_of(html)
            headings = [text for tag, _, text in blocks if tag[0] == "h"]
            prose = [(tag, text) for tag, _, text in blocks if tag[0] != "h"]
            plate = ("<img" in html or "<image" in html) and sum(len(t.split()) for _, t in prose) <= PLATE_WORDS
            if not headings and plate:
                continue
            if headings or at < 0 and prose:
                at, seq, heading = at + 1, 0, headings[0] if headings else None
            for tag, text in prose:
                out.append((title, at, heading, seq, tag, text))
                seq += 1
            if headings and not prose:  # a chapter of its heading alone is still one
                out.append((title, at, heading, seq, None, None))
    return out


def chapters(books: DataFrame) -> DataFrame:
    """SCHEMA's rows of books(path, content); a null content has none, an archive that can't be read is an error that names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                if not content.is_valid:
                    continue
                try:
                    rows = [(path.as_py(), *r) for r in chapters_of(content.as_py())]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as error:
                    raise ValueError(f"{path.as_py()} is no readable EPUB: {error}") from error
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return books.select("path", "content").mapInArrow(run, SCHEMA)


def container(title: str, documents: list[str]) -> bytes:
    """An EPUB of the documents in that order."""
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        book.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/package.opf"/></rootfiles></container>')
        items = "".join(f'<item id="d{i}" href="text/d{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(documents)))
        refs = "".join(f'<itemref idref="d{i}"/>' for i in range(len(documents)))
        head = f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></metadata>'
        book.writestr("OPS/package.opf", f'<package xmlns="http://www.idpf.org/2007/opf">{head}<manifest>{items}</manifest><spine>{refs}</spine></package>')
        for i, text in enumerate(documents):
            book.writestr(f"OPS/text/d{i}.xhtml", text)
    return out.getvalue()


def containers(documents: DataFrame, book_col: str, order_col: str, html_col: str) -> DataFrame:
    """(path, content): an EPUB for each book, whose documents make one task's rows."""
    import pandas as pd

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        return pd.DataFrame({"path": [f"{key[0]}.epub"], "content": [container(str(key[0]), [h or "" for h in rows["html"]])]})

    slim = documents.select(F.col(book_col).alias("book"), F.col(order_col).alias("place"), F.col(html_col).alias("html"))
    return slim.groupBy("book").applyInPandas(build, "path string, content binary")
