"""Readers: report metadata, parsed reports, chunks and files scanned for text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "code string, name string, exchange string, period string, kind string, title string, url string, announcement_date string, file string, bytes bigint, source string"
CHUNK = "id string, code string, name string, exchange string, period string, kind string, title string, url string, announcement_date string, section string, subsection string, page_start int, page_end int, type string, table_rows int, table_caption string, text string, n_chars int"
PARSED = "key string, num_pages int, num_tables int, pages array<struct<page int, text string>>, tables array<struct<page int, `index` int, markdown string, rows int, cols int>>, sections array<struct<page int, title string>>"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Report metadata from JSON files that each hold one object by report key: ``key`` and its fields."""
    whole = spark.read.text(path, wholetext=True)
    by_key = F.from_json("value", f"map<string, struct<{METADATA.replace(' string', ': string').replace(' bigint', ': bigint')}>>")
    return whole.select(F.explode(by_key).alias("key", "m")).select("key", "m.*")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines, with a declared schema; absent optional fields are null."""
    return spark.read.schema(CHUNK).json(path)


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Parsed reports, one JSON document per file."""
    return spark.read.schema(PARSED).json(path, multiLine=True)


def pages_of(parsed: DataFrame) -> DataFrame:
    """``key``, ``page``, ``text`` of parsed reports."""
    return parsed.select("key", F.explode("pages").alias("p")).select("key", "p.page", "p.text")


class _Text(HTMLParser):
    """The visible text of a page; blocks end lines."""

    hidden = {"script", "style", "noscript", "template"}
    breaks = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.hidden
        if tag in self.breaks:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.depth = max(0, self.depth - (tag in self.hidden))
        if tag in self.breaks:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.out.append(data)


def html_text(content: bytes) -> list[str]:
    """One page of text from HTML bytes."""
    parser = _Text()
    parser.feed(content.decode("utf-8", "replace"))
    lines = (" ".join(x.split()) for x in "".join(parser.out).split("\n"))
    return ["\n".join(x for x in lines if x)]


class _Layout(_Text):
    """The text and the tables of a page, in order."""

    def __init__(self) -> None:
        super().__init__()
        self.items: list[tuple[str, object]] = []
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def flush(self) -> None:
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        text = "\n".join(x for x in lines if x)
        if text:
            self.items.append(("text", text))
        self.out = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table" and self.rows is None:
            self.flush()
            self.rows = []
        elif self.rows is None:
            super().handle_starttag(tag, attrs)
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if self.rows is None:
            super().handle_endtag(tag)
        elif tag in ("td", "th") and self.cell is not None:
            self.rows = self.rows or [[]]
            self.rows[-1].append("".join(self.cell))
            self.cell = None
        elif tag == "table":
            self.items.append(("table", self.rows))
            self.rows = self.cell = None

    def handle_data(self, data: str) -> None:
        if self.rows is None:
            super().handle_data(data)
        elif self.cell is not None:
            self.cell.append(data)


#: What a layout parser gives for each page: blocks (x0, y0, x1, y1, kind, text) and tables (x0, y0, x1, y1, rows of cells).
PageLayout = tuple[list[tuple], list[tuple]]


def html_layout(content: bytes) -> list[PageLayout]:
    """One page from HTML bytes: text and tables one under the other, ten points apart."""
    parser = _Layout()
    parser.feed(content.decode("utf-8", "replace"))
    parser.flush()
    placed = [(0.0, 10.0 * k, 1.0, 10.0 * k + 1, kind, held) for k, (kind, held) in enumerate(parser.items)]
    return [([x for x in placed if x[4] == "text"], [(*x[:4], x[5]) for x in placed if x[4] == "table"])]


def pdf_layout(content: bytes) -> list[PageLayout]:
    """Pages of a PDF with the tables that are found on them, where a PDF library is installed."""
    try:
        import fitz
    except ImportError as missing:
        raise RuntimeError("no PDF library is installed") from missing
    with fitz.open(stream=content, filetype="pdf") as pdf:
        return [([(*b[:4], "text" if b[6] == 0 else "image", b[4]) for b in page.get_text("blocks")], [(*t.bbox, t.extract()) for t in page.find_tables().tables]) for page in pdf]


LAYOUTS: dict[str, Callable[[bytes], list[PageLayout]]] = {"html": html_layout, "htm": html_layout, "pdf": pdf_layout}


def scan_layout(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], list[PageLayout]]] | None = None) -> DataFrame:
    """The layout of all files under ``path``, for layout.parsed_pages(): ``key`` (the file), ``page``, ``item`` (page, block or table), ``seq``, the box, ``kind``, ``text``, ``rows``, ``error``.

    Every page is one row, so that empty ones are known. A file that can't be parsed is one row with its reason.
    """
    known = parsers or LAYOUTS
    names = ["key", "page", "item", "seq", "x0", "y0", "x1", "y1", "kind", "text", "rows", "error"]
    box = [None] * 4

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    own: list[tuple] = []
                    for page, (blocks, tables) in enumerate(known[name.rpartition(".")[2].lower()](content), 1):
                        own.append((name, page, "page", 0, *box, None, None, None, None))
                        own += [(name, page, "block", k, *map(float, b[:4]), b[4], b[5], None, None) for k, b in enumerate(blocks)]
                        own += [(name, page, "table", k, *map(float, t[:4]), None, None, t[4], None) for k, t in enumerate(tables)]
                    out += own
                except Exception as why:  # noqa: BLE001
                    out.append((name, None, None, None, *box, None, None, None, f"{type(why).__name__}: {why}"))
            yield pd.DataFrame(out, columns=names).astype({"page": "Int32", "seq": "Int32", **dict.fromkeys(names[4:8], "float64")})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "key string, page int, item string, seq int, x0 double, y0 double, x1 double, y1 double, kind string, text string, rows array<array<string>>, error string")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """People's verdicts from JSON files that hold them under ``questions``: ``id``, ``expected``, ``answer``, ``verdict``, ``analysis``."""
    one = "struct<id: string, expected: string, answer: string, verdict: string, analysis: string>"
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"struct<questions: array<{one}>>").getField("questions")).alias("q")).select("q.*")


def read_announcements(spark: SparkSession, path: str) -> DataFrame:
    """Announcements from recorded answers of a paged search, one JSON file per page with ``pageNum``, ``hasMore`` and ``announcements``.

    Pages count up to the first that has no more after it; a page without announcements adds none. Result: ``page``, ``code``,
    ``title``, ``url`` and ``announced`` (milliseconds).
    """
    one = "struct<secCode: string, announcementTitle: string, adjunctUrl: string, announcementTime: bigint>"
    pages = spark.read.schema(f"pageNum int, hasMore boolean, announcements array<{one}>").json(path, multiLine=True)
    last = pages.where(~F.coalesce("hasMore", F.lit(False))).agg(F.min("pageNum")).first()[0]
    kept = pages if last is None else pages.where(F.col("pageNum") <= last)
    return kept.select(F.col("pageNum").alias("page"), F.explode("announcements").alias("a")).select("page", F.col("a.secCode").alias("code"), F.col("a.announcementTitle").alias("title"), F.col("a.adjunctUrl").alias("url"), F.col("a.announcementTime").alias("announced"))


def plain_text(content: bytes) -> list[str]:
    """Pages of plain text, divided by form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def pdf_text(content: bytes) -> list[str]:
    """Pages of a PDF, where a PDF library is installed."""
    try:
        import fitz
    except ImportError as missing:
        raise RuntimeError("no PDF library is installed") from missing
    with fitz.open(stream=content, filetype="pdf") as pdf:
        return [page.get_text() for page in pdf]


PARSERS: dict[str, Callable[[bytes], list[str]]] = {"html": html_text, "htm": html_text, "txt": plain_text, "md": plain_text, "pdf": pdf_text}


def scan_files(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """``path``, ``page``, ``text``, ``error``: the pages of all files under ``path``, parsed by extension.

    A file that can't be parsed is one row with null page and text and the reason; it never ends the scan.
    """
    known = parsers or PARSERS

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    pages = known[name.rpartition(".")[2].lower()](content)
                    out += [(name, k, t, None) for k, t in enumerate(pages, 1)]
                except Exception as why:  # noqa: BLE001
                    out.append((name, None, None, f"{type(why).__name__}: {why}"))
            yield pd.DataFrame(out, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, page int, text string, error string")
