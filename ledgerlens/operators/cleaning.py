"""Page text made into chunks: table segments, boilerplate, page numbers, headings, captions and chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.functions.vocabulary import LEAST, MOST, PAGE_SHARE, SHORT_LINE, TARGET
from ledgerlens.runtime import cut_lineage, salted_join

# The marks around tables in page text, and the forms of headings and page numbers.
OPEN, CLOSE = "[表格开始]", "[表格结束]"
SECTION = r"^\s*第\s*[一二三四五六七八九十百]+\s*节"
SUBSECTION = r"^\s*(?:[一二三四五六七八九十]+\s*[、.．]|（[一二三四五六七八九十]+）|\d+\s*[、.．]\s*\S|\d+\.\d+\s*\S)"
PAGE_NUMBER = r"^(\d{1,4})(?:\s*/\s*(\d{1,4}))?$"
_STRIP = r"(?U)^\s+|\s+$"


def latest_pages(pages: DataFrame) -> DataFrame:
    """``key``, ``page``, ``text``: the last extraction of each page; rows without key or page are left out."""
    last = F.max(F.struct("extracted_at", F.coalesce("text", F.lit("")).alias("text"))).alias("x")
    return pages.where("key is not null and page is not null").groupBy("key", "page").agg(last).select("key", "page", "x.text")


def segments(pages: DataFrame) -> DataFrame:
    """``key``, ``page``, ``seq``, ``kind`` (text or table), ``content``: page text cut at the table marks, tables without them."""
    opened = F.regexp_replace("text", re.escape(OPEN) + r"\n([\s\S]*?)\n" + re.escape(CLOSE), "\u0001\u0002$1\u0001")
    parts = pages.select("key", "page", F.posexplode(F.split(opened, "\u0001")).alias("seq", "part")).where("part <> ''")
    is_table = F.col("part").startswith("\u0002")
    return parts.select("key", "page", "seq", F.when(is_table, "table").otherwise("text").alias("kind"), F.when(is_table, F.regexp_replace(F.substring("part", 2, 10_000_000), _STRIP, "")).otherwise(F.col("part")).alias("content"))


def lines(pages: DataFrame) -> DataFrame:
    """``key``, ``page``, ``seq``, ``line``: the trimmed lines of page text, blank ones included."""
    return pages.select("key", "page", F.posexplode(F.split("text", "\n")).alias("seq", "raw")).select("key", "page", "seq", F.regexp_replace("raw", _STRIP, "").alias("line"))


def boilerplate(pages: DataFrame, share: float = PAGE_SHARE, short: int = SHORT_LINE) -> DataFrame:
    """``key``, ``line``, ``on_pages``: lines of under ``short`` characters on more than ``share`` of a report's pages.

    Distinct (key, line, page) combine on the map side; the page counts come back over a salted join.
    """
    counts = lines(pages).where((F.col("line") != "") & (F.char_length("line") < short)).select("key", "page", "line").distinct().groupBy("key", "line").agg(F.count("*").alias("on_pages"))
    sizes = pages.groupBy("key").agg(F.count_distinct("page").alias("pages"))
    return salted_join(counts, sizes, ["key"], "line").where(F.col("on_pages") > F.col("pages") * share).select("key", "line", "on_pages")


def is_page_number(line: Column, page: Column) -> Column:
    """A line that is the page's number, or number / total with either within one of it."""
    number = lambda k: F.regexp_extract(line, PAGE_NUMBER, k).try_cast("int")
    near = lambda n: F.coalesce(F.abs(n - page) <= 1, F.lit(False))
    return line.rlike(PAGE_NUMBER) & (near(number(1)) | near(number(2)))


def page_numbers(pages: DataFrame) -> DataFrame:
    """``key``, ``page``, ``seq``, ``line`` of page-number lines."""
    return lines(pages).where(is_page_number(F.col("line"), F.col("page")))


def sections(pages: DataFrame) -> DataFrame:
    """``key``, ``page``, ``title``: where sections start; a title alone on its line takes in the next line that isn't blank, within three."""
    w = W.partitionBy("key").orderBy("page", "seq")
    ahead = [F.lead("line", k).over(w) for k in (1, 2, 3)]
    following = F.coalesce(*(F.nullif(a, F.lit("")) for a in ahead))
    rows = lines(pages).withColumn("following", following)
    rest = F.regexp_replace(F.regexp_replace("line", SECTION, ""), _STRIP, "")
    joins = (F.char_length(rest) < 2) & (F.char_length("following") < 40) & ~F.col("following").rlike(SECTION)
    title = F.when(F.coalesce(joins, F.lit(False)), F.concat_ws(" ", "line", "following")).otherwise(F.col("line"))
    return rows.where(F.col("line").rlike(SECTION) & (F.char_length("line") < 60)).select("key", "page", "seq", title.alias("title"))


def carried_sections(pages: DataFrame) -> DataFrame:
    """``key``, ``page``, ``seq``, ``section``: each line's running section heading, empty before the first."""
    w = W.partitionBy("key").orderBy("page", "seq").rowsBetween(W.unboundedPreceding, 0)
    heading = F.when(F.col("line").rlike(SECTION) & (F.char_length("line") <= 60), F.col("line"))
    return lines(pages).where("line <> ''").select("key", "page", "seq", F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit("")).alias("section"))


def captions(pages: DataFrame) -> DataFrame:
    """``key``, ``page``, ``seq``, ``caption`` of each table: the latest of the four lines before it that looks like a title.

    Boilerplate and page numbers are no lines here; a table without such a line has an empty caption.
    """
    w = W.partitionBy("key").orderBy("page", "seq", "at")
    stream = segments(pages).withColumn("piece", F.when(F.col("kind") == "table", F.array("content")).otherwise(F.split("content", "\n")))
    flat = stream.select("key", "page", "seq", "kind", F.posexplode("piece").alias("at", "raw")).withColumn("line", F.when(F.col("kind") == "table", F.lit("")).otherwise(F.regexp_replace("raw", _STRIP, "")))
    solid = flat.where((F.col("kind") == "table") | ((F.col("line") != "") & ~is_page_number(F.col("line"), F.col("page"))))
    solid = solid.join(boilerplate(pages).select("key", "line"), ["key", "line"], "left_anti")
    fits = F.when((F.col("kind") == "text") & F.char_length("line").between(3, 40) & ~F.col("line").rlike("[。，；]$"), F.col("line"))
    # The last four lines of text, tables not counted among them.
    text_no = F.count(F.when(F.col("kind") == "text", 1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    numbered = solid.withColumn("no", text_no).withColumn("fit", F.when(fits.isNotNull(), F.struct(F.col("no").alias("no"), fits.alias("line"))))
    last = F.last("fit", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    tables = numbered.withColumn("last", last).where("kind = 'table'")
    return tables.select("key", "page", "seq", F.when(F.col("last.no") > F.col("no") - 4, F.col("last.line")).otherwise("").alias("caption"))


def collapse_blank_lines(text: Column) -> Column:
    """Three or more line feeds in a row made two."""
    return F.regexp_replace(text, "\n{3,}", "\n\n")


# For each event of a report, the buffered characters from which the buffer becomes a chunk there, and what becomes of a smaller buffer.
STEPS = {"line": (MOST, "stays"), "blank": (TARGET, "stays"), "sub": (LEAST, "stays"), "section": (LEAST, "goes"), "table": (200, "leads"), "end": (120, "goes")}
# Fixed value: a line shorter than this that fills the buffer also opens the next one.
CARRIED = 300


def report_events(pages: DataFrame) -> DataFrame:
    """Reports as ordered events: ``key``, ``pos`` from 1, ``page``, ``kind``, ``content``, and at each event the ``section`` and ``subsection`` in force before it and a table's ``caption``.

    Kinds are ``line``, ``blank``, ``table``, ``section``, ``sub`` (a subsection heading) and one ``end`` per report.
    Boilerplate and page numbers are no events. A section heading alone on its line takes in the next event that is
    not blank if that is a line of under 40 characters. Everything is found by windows over one report, a
    bounded document.
    """
    size = F.char_length("content")
    pieces = F.when(F.col("kind") == "table", F.array("content")).otherwise(F.split("content", "\n"))
    flat = segments(pages).select("key", "page", "seq", "kind", F.posexplode(pieces).alias("at", "raw"))
    read = flat.select("key", "page", "seq", "at", F.when(F.col("kind") == "table", F.col("raw")).otherwise(F.regexp_replace("raw", _STRIP, "")).alias("content"), "kind")
    read = read.withColumn("kind", F.when(F.col("kind") == "table", "table").when(F.col("content") == "", "blank").otherwise("line"))
    noise = boilerplate(pages).select("key", F.col("line").alias("content"), F.lit(True).alias("noise"))
    kept = read.join(noise, ["key", "content"], "left").where((F.col("kind") != "line") | (F.col("noise").isNull() & ~is_page_number(F.col("content"), F.col("page")))).drop("noise")
    order = W.partitionBy("key").orderBy("page", "seq", "at")

    heading = (F.col("kind") == "line") & (size <= 60) & F.col("content").rlike(SECTION)
    alone = F.char_length(F.regexp_replace(F.regexp_replace("content", SECTION, ""), _STRIP, "")) < 2
    after = F.lead(F.when(F.col("kind") == "line", F.col("content"))).over(order)
    solid = kept.where("kind <> 'blank'").withColumn("heading", heading).withColumn("after", after)
    solid = solid.withColumn("takes", F.coalesce(F.col("heading") & alone & (F.char_length("after") < 40), F.lit(False)))
    # In a row of headings that would each take in the next, every second one is taken in and takes nothing itself.
    solid = solid.withColumn("run", F.sum((~F.col("takes")).cast("int")).over(order))
    place = F.sum(F.col("takes").cast("int")).over(W.partitionBy("key", "run").orderBy("page", "seq", "at"))
    solid = solid.withColumn("takes", F.col("takes") & (place % 2 == 1))
    solid = solid.withColumn("taken", F.coalesce(F.lag("takes").over(order), F.lit(False))).where(~F.col("taken"))
    kind = F.when(F.col("heading"), "section").when((F.col("kind") == "line") & (size < 50) & F.col("content").rlike(SUBSECTION), "sub").otherwise(F.col("kind"))
    solid = solid.select("key", "page", "seq", "at", F.when(F.col("takes"), F.concat_ws(" ", "content", "after")).otherwise(F.col("content")).alias("content"), kind.alias("kind"))
    ends = pages.groupBy("key").agg(F.max("page").alias("page")).select("key", "page", F.lit(2**31 - 1).alias("seq"), F.lit(0).alias("at"), F.lit("").alias("content"), F.lit("end").alias("kind"))
    events = solid.unionByName(kept.where("kind = 'blank'").select(*solid.columns)).unionByName(ends)

    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    headed = events.withColumn("pos", F.row_number().over(order)).withColumn("section_no", F.count(F.when(F.col("kind") == "section", 1)).over(so_far))
    inside = W.partitionBy("key", "section_no").orderBy("page", "seq", "at").rowsBetween(W.unboundedPreceding, 0)
    told = F.col("kind").isin("section", "sub", "line")
    headed = headed.withColumn("section", F.last(F.when(F.col("kind") == "section", F.col("content")), ignorenulls=True).over(so_far))
    headed = headed.withColumn("subsection", F.last(F.when(F.col("kind") == "sub", F.col("content")), ignorenulls=True).over(inside)).withColumn("no", F.count(F.when(told, 1)).over(inside))
    fits = told & size.between(3, 40) & ~F.col("content").rlike("[。，；]$")
    headed = headed.withColumn("title", F.last(F.when(fits, F.struct("no", "content")), ignorenulls=True).over(inside))
    caption = F.when(F.col("kind") == "table", F.when(F.col("title.no") > F.col("no") - 4, F.col("title.content")).otherwise(""))
    before = lambda c: F.coalesce(F.lag(c).over(order), F.lit("")).alias(c)
    return headed.select("key", "pos", "page", "kind", "content", before("section"), before("subsection"), caption.alias("caption"))


def packed(kinds: list[str], sizes: list[int]) -> list[tuple[int, int, int]]:
    """Chunk number from 1, the event that ends the chunk, and each event whose content it holds; events are numbered from 0.

    Only sizes matter: the buffer is filled by lines, and every event is a step of STEPS for it.
    """
    out: list[tuple[int, int, int]] = []
    held: list[int] = []
    number = total = 0
    for at, (kind, size) in enumerate(zip(kinds, sizes, strict=True)):
        if kind == "line":
            held, total = [*held, at], total + size
        enough, otherwise = STEPS[kind]
        full = total >= enough
        if full:
            number += 1
            out += [(number, at, k) for k in held]
        if kind == "table":
            number += 1
            out += [(number, at, k) for k in ([] if full else held) + [at]]
        carried = full and kind == "line" and size < CARRIED
        if carried:
            held, total = [at], size
        elif full or otherwise != "stays":
            held, total = [], 0
    return out


def chunk_reports(pages: DataFrame) -> DataFrame:
    """Chunks of each report: ``id``, ``key``, ``section``, ``subsection``, ``page_start``, ``page_end``, ``type``, ``table_rows``, ``table_caption``, ``text``, ``n_chars``.

    Headings, captions and labels are found by windows, see report_events(). Where a chunk ends depends on all sizes
    before it in the report, so the sizes of one report, and nothing else, are folded as a group; the contents
    are then joined to their chunks. A table takes in a short text before it; a longer one, or one of 200 characters or
    more, is a chunk of its own.
    """
    events = cut_lineage(report_events(pages))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        key, pos = group["key"].iloc[0], group["pos"].to_numpy()
        return pd.DataFrame([(key, n, pos[at], pos[k]) for n, at, k in packed(group["kind"].tolist(), group["size"].tolist())], columns=["key", "no", "at", "pos"])

    sizes = events.select("key", "pos", "kind", F.char_length("content").alias("size"))
    places = sizes.groupBy("key").applyInPandas(fold, "key string, no int, at int, pos int")
    held = places.join(events.select("key", "pos", "page", "kind", "content"), ["key", "pos"])
    is_table, table = F.col("kind") == "table", F.max(F.when(F.col("kind") == "table", F.col("content")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n")
    made = held.groupBy("key", "no", "at").agg(F.min("page").alias("first"), F.max("page").alias("last"), text.alias("text"), F.max(is_table).alias("is_table"), (F.length(table) - F.length(F.replace(table, F.lit("\n"), F.lit(""))) + 1).alias("rows"))
    ends = events.select("key", F.col("pos").alias("at"), "section", "subsection", "caption")
    page = F.when(F.col("is_table"), F.col("last")).otherwise(F.col("first"))
    return made.join(ends, ["key", "at"]).select(F.format_string("%s#%04d", "key", "no").alias("id"), "key", "section", "subsection", page.alias("page_start"), F.col("last").alias("page_end"), F.when(F.col("is_table"), "table").otherwise("text").alias("type"), F.when(F.col("is_table"), F.col("rows")).alias("table_rows"), F.when(F.col("is_table"), F.col("caption")).alias("table_caption"), "text", F.char_length("text").alias("n_chars"))
