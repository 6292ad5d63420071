"""Page layout: text blocks outside tables, in reading order, joined to page text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.cleaning import CLOSE, OPEN, collapse_blank_lines
from ledgerlens.operators.tables import to_markdown

#: Points by which a table's box is widened on every side.
PADDING = 2


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that are text and not blank. ``blocks`` has ``key``, ``page``, ``x0``, ``y0``, ``x1``, ``y1``, ``kind``, ``text``."""
    return blocks.where((F.col("kind") == "text") & (F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != ""))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks whose centre lies in no table's box of the same page, boxes widened by PADDING; a range anti-join within the page."""
    b, t = blocks.alias("b"), tables.alias("t")
    x, y = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    inside = x.between(F.col("t.x0") - PADDING, F.col("t.x1") + PADDING) & y.between(F.col("t.y0") - PADDING, F.col("t.y1") + PADDING)
    return b.join(t, (F.col("b.key") == F.col("t.key")) & (F.col("b.page") == F.col("t.page")) & inside, "left_anti")


def page_text(items: DataFrame) -> DataFrame:
    """``key``, ``page``, ``text``: a page's items (``y0``, ``seq``, ``text``) from top to bottom, blank runs collapsed. A page is a bounded group."""
    ordered = F.array_sort(F.collect_list(F.struct("y0", "seq", "text")))
    text = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    return items.groupBy("key", "page").agg(collapse_blank_lines(text).alias("text"))


def parsed_tables(items: DataFrame) -> DataFrame:
    """Tables of scanned pages that have two rows with content or more: ``key``, ``page``, ``index`` from 0, ``markdown``, ``rows``, ``cols`` and the box."""
    drawn = items.where("item = 'table'").withColumn("markdown", to_markdown(F.col("rows"))).where("markdown is not null")
    full = F.filter("rows", lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    return drawn.select("key", "page", F.col("seq").alias("index"), "markdown", F.size(full).alias("rows"), F.array_max(F.transform(full, lambda r: F.size(r))).alias("cols"), "x0", "y0", "x1", "y1")


def parsed_pages(items: DataFrame) -> DataFrame:
    """``key``, ``page``, ``text`` of scanned pages (scan_layout()): text blocks outside tables and marked tables, from top to bottom.

    At equal heights text comes first. Every page that was scanned comes out, an empty one with empty text; files that could not
    be parsed don't.
    """
    tables = parsed_tables(items)
    strip = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    blocks = outside_tables(text_blocks(items.where("item = 'block'")), tables).select("key", "page", "y0", "seq", strip.alias("text"))
    drawn = tables.select("key", "page", "y0", (F.col("index") + (1 << 30)).alias("seq"), F.concat(F.lit(f"\n{OPEN}\n"), "markdown", F.lit(f"\n{CLOSE}\n")).alias("text"))
    pages = items.where("item = 'page'").select("key", "page").distinct()
    return pages.join(page_text(blocks.unionByName(drawn)), ["key", "page"], "left").select("key", "page", F.coalesce("text", F.lit("")).alias("text"))
