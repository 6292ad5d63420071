"""Lines repeated across one source's documents, found with compressed document bitmaps and removed from each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.plans.ranking import number_all
from ledgerlens.runtime import HOT_ROWS, broadcast_if_small, cut_lineage, spread_join

#: Documents (pages) that one 64-bit word of a bitmap covers.
WORD = 64
#: Words of repeated lines, with the lines, that may be broadcast to the documents.
LOOKUP_ROWS = 20_000


def line_key(line: Column) -> Column:
    """The form in which variants of a line agree: outer whitespace gone, inner runs one space, digit runs ``#``."""
    spaced = F.regexp_replace(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.regexp_replace(spaced, r"(?U)\d+", "#")


def _counts(key: Column) -> Column:
    return (key != "") & ~key.startswith("|") & ~key.startswith("[")


def _numbered(df: DataFrame, source: str, doc: str, text: str) -> DataFrame:
    """``source``, ``doc``, ``text`` and the document's ``number``, on which bitmaps are built: an integer id itself, else its place among all ids.

    ``number`` is null where source or document is.
    """
    rows = df.select(F.col(source).alias("source"), F.col(doc).alias("doc"), F.col(text).alias("text"))
    if isinstance(df.schema[doc].dataType, T.IntegralType):
        number = F.when(F.col("source").isNotNull(), F.col("doc").cast("long"))
        return rows.select("source", F.col("doc").cast("long").alias("doc"), "text", number.alias("number"))
    known = rows.select("source", "doc").where("source is not null and doc is not null").distinct()
    return rows.join(number_all(known, [F.col("source"), F.col("doc")]), ["source", "doc"], "left").select("source", "doc", "text", "number")


def _word() -> tuple[Column, Column]:
    """The bitmap word of a document number, and its bit there."""
    return F.floor(F.col("number") / WORD).cast("long").alias("word_no"), F.expr("shiftleft(1L, cast(pmod(number, 64) as int))")


def _lines(rows: DataFrame) -> DataFrame:
    """``source``, ``number``, ``line`` and ``key`` (a hash of source and line) of each document's different lines that count."""
    lines = F.explode(F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line_key)))
    kept = rows.where("number is not null").select("source", "number", lines.alias("line")).where(_counts(F.col("line")))
    return kept.withColumn("key", F.xxhash64("source", "line"))


def _repeated(rows: DataFrame, share: float, least_docs: int, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """The bitmaps of the repeated lines (``source``, ``line``, ``word_no``, ``bits``) and each line's ``docs`` and ``source_docs``.

    First the documents of every line are united in bitmaps under a 64-bit hash, so that rare lines, by far the
    most, cross the network as a few numbers; two lines that share a hash can only seem more frequent. For the lines
    that seem frequent enough the bitmaps are then built again under the lines themselves: cardinalities are exact.
    """
    word_no, bit = _word()
    words = rows.where("number is not null").groupBy("source", word_no).agg(F.bit_or(bit).alias("bits"))
    sizes = words.groupBy("source").agg(F.sum(F.bit_count("bits")).cast("long").alias("source_docs")).where(F.col("source_docs") >= least_docs)
    sizes = cut_lineage(sizes)
    lines = _lines(rows)
    by_hash = lines.groupBy("source", "key", word_no).agg(F.bit_or(bit).alias("bits"))
    counts = by_hash.groupBy("source", "key").agg(F.sum(F.bit_count("bits")).cast("long").alias("docs"))
    # A line on one document passes only where a source has fewer than 1 / share documents.
    likely = counts.where(F.col("docs") > F.lit(share) * F.lit(least_docs))
    many = sizes.count()
    sized = likely.join(F.broadcast(sizes), "source") if broadcast_if_small(sizes, many) is not sizes else spread_join(likely, sizes, ["source"], "key", most=hot_rows)
    frequent = cut_lineage(sized.where(F.col("docs") > F.lit(share) * F.col("source_docs")).select("key", "source_docs").distinct())
    few = frequent.count()
    again = lines.join(F.broadcast(frequent), "key") if broadcast_if_small(frequent, few) is not frequent else spread_join(lines, frequent, ["key"], "number", most=hot_rows)
    bitmaps = cut_lineage(again.groupBy("source", "line", "source_docs", word_no).agg(F.bit_or(bit).alias("bits")))
    exact = bitmaps.groupBy("source", "line", "source_docs").agg(F.sum(F.bit_count("bits")).cast("long").alias("docs"))
    return bitmaps, exact.where(F.col("docs") > F.lit(share) * F.col("source_docs")).select("source", "line", "docs", "source_docs")


def repeated_lines(df: DataFrame, source: str, doc: str, text: str, share: float = 0.3, least_docs: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Lines on more than ``share`` of a source's documents: ``source``, ``line``, ``docs`` (of the line), ``source_docs``.

    Only sources with at least ``least_docs`` different documents are judged. Lines are split at line feeds and
    compared by line_key(); empty lines and lines that begin with ``|`` or ``[`` do not count. The union of
    variants, of repeated rows and of tasks' parts is a bitwise or of bitmap words, which combines on the map side.

    Defined cases: documents may have ids of any type; null and empty texts are documents without lines; rows without
    source or document take no part; repeated rows count once; several versions of one document count as one document
    that holds the lines of all; an empty table gives an empty result.
    """
    return _repeated(_numbered(df, source, doc, text), share, least_docs, hot_rows)[1]


def without_repeated_lines(df: DataFrame, source: str, doc: str, text: str, share: float = 0.3, least_docs: int = 5, hot_rows: int = HOT_ROWS, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Each document without its source's repeated lines: ``source``, ``doc``, ``text``, ``removed`` (lines).

    A source's repeated lines and their bitmaps come back to its documents, counted and broadcast or over a spread
    join: fewer than lines-per-document / share of them exist. A line is deleted where its bitmap holds the document's
    bit. All other lines stay as they are, in order.

    Defined cases: null text stays null with ``removed`` 0; rows equal in source, document and text come out
    once; rows without source or document stay whole; integer document ids come out as long.
    """
    rows = _numbered(df, source, doc, text)
    bitmaps, marked = _repeated(rows, share, least_docs, hot_rows)
    held = bitmaps.join(marked.select("source", "line"), ["source", "line"], "left_semi")
    lookup = cut_lineage(held.groupBy("source", "word_no").agg(F.collect_list(F.struct("line", "bits")).alias("marks")))
    word_no, bit = _word()
    keyed = rows.withColumn("word_no", word_no)
    many = lookup.count()
    joined = keyed.join(F.broadcast(lookup), ["source", "word_no"], "left") if many <= lookup_rows else spread_join(keyed, lookup, ["source", "word_no"], "text", "left", hot_rows)
    own = F.transform(F.filter(F.coalesce("marks", F.array().cast("array<struct<line:string,bits:bigint>>")), lambda m: m["bits"].bitwiseAND(bit) != 0), lambda m: m["line"])
    parts = joined.select("source", "doc", "text", F.split("text", "\n").alias("lines"), own.alias("own"))
    kept = parts.withColumn("kept", F.filter("lines", lambda x: ~F.array_contains(F.col("own"), line_key(x))))
    return kept.select("source", "doc", F.array_join("kept", "\n").alias("text"), F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).alias("removed")).distinct()
