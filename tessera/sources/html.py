"""HTML pages as ordered paragraphs: a scan that the SQL functions can't express, in an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote"}
#: Characters of pages whose paragraphs are held at once.
FEW = 1 << 20
SKIPPED = {"script", "style", "head", "nav", "footer"}


class _Paragraphs(HTMLParser):
    """Text of block elements in document order, with the heading that they stand under."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, str]] = []
        self.heading, self.tag, self.parts, self.skip = "", "", [], 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).replace("\xa0", " ").split())
        if self.tag and text:
            if self.tag[0] == "h":
                self.heading = text
            self.out.append((self.tag, self.heading, text))
        self.tag, self.parts = "", []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BLOCKS and not self.skip:
            self._flush()
            self.tag = tag
        elif tag == "br" and self.tag:
            self.parts.append(" ")

    def handle_endtag(self, tag) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == self.tag:
            self._flush()

    def handle_data(self, data) -> None:
        if self.tag and not self.skip:
            self.parts.append(data)

    def close(self) -> None:
        super().close()
        self._flush()


def paragraphs_of(html: str | None) -> list[tuple[str, str, str]]:
    parser = _Paragraphs()
    parser.feed(html or "")
    parser.close()
    return parser.out


def _few(b: pa.RecordBatch) -> Iterator[list[tuple]]:
    """The paragraphs of a batch's pages, of about FEW characters of pages at a time: a batch of long pages is never all there as Python objects."""
    rows, size = [], 0
    for i, html in zip(b.column(0), b.column(1)):
        i, html = i.as_py(), html.as_py()
        rows += [(i, n, *p) for n, p in enumerate(paragraphs_of(html))]
        size += len(html or "")
        if size >= FEW:
            yield rows
            rows, size = [], 0
    yield rows


def paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, seq, tag, heading, text) of every block with a word, in document order; a null page has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, kind in ((rows, b.schema.field(0).type) for b in batches for rows in _few(b)):
            types = [kind, pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["id", "seq", "tag", "heading", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"id {kind}, seq int, tag string, heading string, text string").withColumnRenamed("id", id_col)


def heading_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """How often h1, h2 and h3 open over all pages."""
    html = F.lower(html_col)
    return pages.agg(*[F.coalesce(F.sum(F.regexp_count(html, F.lit(f"<h{i}[\\s>]"))), F.lit(0)).alias(f"h{i}") for i in (1, 2, 3)])


def heading_tag(pages: DataFrame) -> DataFrame:
    """The highest heading that opens twice at least, else h1."""
    c = heading_counts(pages)
    return c.select(F.when(F.col("h1") >= 2, "h1").when(F.col("h2") >= 2, "h2").when(F.col("h3") >= 2, "h3").otherwise("h1").alias("tag"))
