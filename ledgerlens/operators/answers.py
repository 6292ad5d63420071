"""Extractive answers: line scores, readable table rows, highlights, HTML tables and prompt context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.functions.text import terms
from ledgerlens.functions.vocabulary import HEADER_NOISE

# Rows of profit without one-off items lose this many hits unless the question names them.
DEDUCTED, ASKS_DEDUCTED, PENALTY = "扣除非经常性损益", "扣非|扣除非经常性损益", 3


def question_terms(text: Column) -> Column:
    """The different terms of a question, without single ASCII letters and digits."""
    return F.filter(F.array_distinct(terms(text)), lambda t: (F.char_length(t) > 1) | ~t.rlike("[a-z0-9]"))


def answer_lines(text: Column) -> Column:
    """Trimmed lines of a chunk without blanks and table rules."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: (x != "") & ~x.startswith("| ---") & ~x.rlike(r"^\|?\s*-{2,}"))


def key_lines(pairs: DataFrame, limit: int) -> DataFrame:
    """``qid``, ``idx``, ``place``, ``line``, ``hits``: the lines of each result that share most terms with its question.

    ``pairs`` has ``qid``, ``question``, ``idx``, ``text``, one row per result. More shared terms win, then
    longer lines (up to 300 characters), then earlier ones; lines that share nothing don't count.
    """
    asked = pairs.select("qid", "question").distinct().select("qid", "question", question_terms(F.col("question")).alias("wanted"))
    rows = pairs.select("qid", "idx", F.posexplode(answer_lines(F.col("text"))).alias("seq", "line")).join(asked, "qid")
    shared = F.size(F.array_intersect("wanted", terms(F.col("line"))))
    loses = ~F.col("question").rlike(ASKS_DEDUCTED) & F.regexp_replace("line", r"(?U)\s+", "").contains(DEDUCTED)
    scored = rows.withColumn("hits", shared - F.when(loses, PENALTY).otherwise(0)).where("hits > 0")
    order = [(F.col("hits") * 1000 + F.least(F.char_length("line"), F.lit(300))).desc(), F.col("seq")]
    return scored.withColumn("place", F.row_number().over(W.partitionBy("qid", "idx").orderBy(*order))).where(F.col("place") <= limit).select("qid", "idx", "place", "line", "hits")


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def row_text(text: Column, line: Column) -> Column:
    """A table row as ``head：value`` pairs, up to 240 characters; other lines as they are.

    The head is the first line of the run of bar lines around the row; noise heads and empty cells are left out.
    """
    all_lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    at = F.array_position(all_lines, F.trim(line)).cast("int")
    before = F.slice(all_lines, F.lit(1), F.greatest(at - 1, F.lit(0)))
    gap = F.coalesce(F.array_max(F.transform(before, lambda x, i: F.when(~x.startswith("|"), i + 1))), F.lit(0))
    head = _cells(F.try_element_at(all_lines, gap + 1))
    noise = F.array(*(F.lit(x) for x in HEADER_NOISE))
    pair = F.zip_with(_cells(line), head, lambda v, h: F.when(v != "", F.when(h.isNotNull() & (h != v) & (h != "") & ~F.array_contains(noise, h), F.concat(h, F.lit("："), v)).otherwise(v)))
    whole = F.substring(F.array_join(F.filter(pair, lambda x: x.isNotNull()), "；"), 1, 240)
    return F.when(F.trim(line).startswith("|") & (at > 0), whole).otherwise(line)


def extractive_answers(results: DataFrame, limit: int = 3, per_result: int = 2) -> DataFrame:
    """``qid``, ``citation`` (the result's rank), ``idx``, ``answer``: the key lines of each question's best results, readable, up to 240 characters.

    ``results`` has ``qid``, ``question``, ``rank``, ``idx``, ``text``, ``type``. A result without a key line gives its first
    two table rows if it is a table, else its first line.
    """
    best = results.where(F.col("rank") <= limit)
    lines = key_lines(best.select("qid", "question", "idx", "text"), per_result)
    found = lines.groupBy("qid", "idx").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("found"))
    both = best.select("qid", "rank", "idx", "text", "type").join(found, ["qid", "idx"], "left")
    bars = F.filter(F.split("text", "\n"), lambda x: F.trim(x).startswith("|"))
    spare = F.when((F.col("type") == "table") & (F.size(bars) > 0), F.array_join(F.slice(bars, 1, 2), " ")).otherwise(F.element_at(F.split("text", "\n"), 1))
    told = F.when(F.col("found").isNotNull(), F.array_join(F.transform("found", lambda x: row_text(F.col("text"), x["line"])), "；")).otherwise(row_text(F.col("text"), spare))
    return both.select("qid", F.col("rank").alias("citation"), "idx", F.substring(told, 1, 240).alias("answer"))


def escape_html(text: Column) -> Column:
    """``&``, ``<`` and ``>`` as entities."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def highlighted(text: Column, words: Column, most: int = 40) -> Column:
    """The escaped text with the ``most`` longest words of over one character marked, one after the other."""
    long = F.filter(words, lambda t: F.char_length(t) > 1)
    keyed = F.array_sort(F.transform(long, lambda t, i: F.struct((-F.char_length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    chosen = F.transform(F.slice(keyed, 1, most), lambda x: x["t"])
    return F.aggregate(chosen, escape_html(text), lambda acc, t: F.replace(acc, t, F.concat(F.lit("<mark>"), t, F.lit("</mark>"))))


def table_html(markdown: Column) -> Column:
    """A Markdown table as HTML; null with fewer than two bar lines. The second bar line is the rule."""
    bars = F.filter(F.split(markdown, "\n"), lambda x: F.trim(x).startswith("|"))
    cell = lambda tag: lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(c), F.lit(f"</{tag}>"))
    row = lambda x, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(_cells(x), cell(tag)), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.slice(bars, F.lit(3), F.greatest(F.size(bars) - 2, F.lit(0))), lambda x: row(x, "td")), "")
    html = F.concat(F.lit('<table class="md-table"><thead>'), row(F.element_at(bars, 1), "th"), F.lit("</thead><tbody>"), body, F.lit("</tbody></table>"))
    return F.when(F.size(bars) >= 2, html)


def prompt_context(results: DataFrame, limit: int = 8, chars: int = 1800) -> DataFrame:
    """``qid``, ``context``: numbered heads and the first ``chars`` characters of the best results, in rank order.

    At most ``limit`` results per question are gathered.
    """
    pages = F.concat(F.col("page_start").cast("string"), F.when(F.col("page_end") > F.col("page_start"), F.concat(F.lit("-"), F.col("page_end").cast("string"))).otherwise(""))
    part = F.concat_ws(" / ", F.nullif("section", F.lit("")), F.nullif("subsection", F.lit("")))
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.concat_ws("｜", F.coalesce("name", F.lit("")), F.coalesce("title", F.lit("")), part, F.concat(F.lit("第 "), F.coalesce(pages, F.lit("")), F.lit(" 页"))))
    block = F.concat(head, F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, chars))
    kept = results.where(F.col("rank") <= limit).select("qid", "rank", "idx", block.alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "idx", "block")))
    return kept.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n---\n\n").alias("context"))
