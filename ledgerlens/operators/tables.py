"""Markdown tables inside text: parsing, split-number repair, metric extraction and comparison over companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.runtime import broadcast_if_small, cut_lineage

#: A run of neighbouring lines that begin with a bar.
BLOCK = r"(?m)(?:^[ \t]*\|[^\n]*(?:\n|\z))+"
#: A row that only separates the head from the body.
RULE = r"^[|\-:\s]*$"
NUMBER = r"^-?[\d,]*\d[\d,]*(?:\.\d+)?%?$"
# What a row's label must and must not hold to be the metric's row.
REVENUE, NOT_REVENUE = "营业收入|营业总收入", "成本|构成|比重|占比|明细|分产品"
PROFIT, PROFIT_REST, NOT_PROFIT = "归属于上市公司股东", "净利润", "扣除非经常性损益"
#: Amounts are larger than this, rates not.
SMALL = 1000


def clean_cell(cell: Column) -> Column:
    """A cell without ordinary and full-width spaces."""
    return F.translate(cell, " 　", "")


def to_number(cell: Column) -> Column:
    """A cell's number, with commas and a percent sign allowed; null for anything else."""
    plain = clean_cell(cell)
    return F.when(plain.rlike(NUMBER), F.regexp_replace(plain, "[,%]", "").try_cast("double"))


def merge_split(cells: Column) -> Column:
    """Cells with numbers joined again that were cut after the decimal point, from left to right.

    A cell of digits that ends in a point takes in the next cell if that is one or two digits; a cell so taken
    in is never itself the start of a join.
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("joined"))

    def step(acc: Column, cell: Column) -> Column:
        last = clean_cell(F.try_element_at(acc["out"], F.lit(-1)))
        joins = F.coalesce(last.rlike(r"^-?[\d,]+\.$") & ~acc["joined"] & clean_cell(cell).rlike(r"^\d{1,2}$"), F.lit(False))
        kept = F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))
        return F.when(joins, F.struct(F.array_append(kept, F.concat(last, clean_cell(cell))).alias("out"), F.lit(True).alias("joined"))).otherwise(F.struct(F.array_append(acc["out"], cell).alias("out"), F.lit(False).alias("joined")))

    return F.aggregate(cells, start, step, lambda acc: acc["out"])


def cells_of(line: Column) -> Column:
    """The trimmed cells of a table line; one bar at either end is its border, so empty edge cells stay."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def table_rows(df: DataFrame, key: str, text: str, merge: bool = True) -> DataFrame:
    """``key``, ``table_no``, ``row_no`` (from 0) and ``cells`` of every table row, without separator rows.

    Each text is parsed within its own row: blocks of neighbouring bar lines are found by one regular expression
    and exploded, so nothing is shuffled. Null and empty texts have no tables; repeated rows are the caller's.
    """
    blocks = df.select(F.col(key), F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BLOCK), F.lit(0))).alias("table_no", "block"))
    kept = F.filter(F.split("block", "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(RULE))
    rows = blocks.select(key, "table_no", F.posexplode(kept).alias("row_no", "line"))
    cells = cells_of(F.col("line"))
    return rows.select(key, "table_no", "row_no", (merge_split(cells) if merge else cells).alias("cells"))


def unit_factor(text: Column) -> Column:
    """10 000 where the text declares its unit as ten thousand yuan, else 1."""
    return F.when(text.rlike(r"单位\s*[:：]\s*(?:人民币)?\s*万元"), 10000.0).otherwise(1.0)


def _parsed(df: DataFrame, key: str, text: str) -> DataFrame:
    blocks = df.select(F.col(key), unit_factor(F.coalesce(text, F.lit(""))).alias("unit"), F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BLOCK), F.lit(0))).alias("table_no", "block"))
    kept = F.filter(F.split("block", "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(RULE))
    grid = blocks.select(key, "unit", "table_no", F.transform(kept, lambda x: merge_split(cells_of(x))).alias("grid"))
    label = lambda row: F.array_join(F.transform(row, clean_cell), "")
    head = F.array_join(F.transform(F.slice("grid", 1, 3), label), "")
    return grid.select(key, "unit", "table_no", "grid", head.alias("head"))


def _is_row(label: Column, following: Column, metric: str) -> Column:
    if metric == "revenue":
        return label.rlike(REVENUE) & ~label.rlike(NOT_REVENUE)
    if metric != "profit":
        raise ValueError("metric is revenue or profit")
    whole = label.contains(PROFIT) & ~label.contains(NOT_PROFIT)
    return whole & (label.contains(PROFIT_REST) | (following.contains(PROFIT_REST) & ~following.contains(NOT_PROFIT)))


def extract_metric(df: DataFrame, key: str, text: str, metric: str) -> DataFrame:
    """``key``, ``now``, ``prev``, ``pct`` in yuan of texts whose tables hold the metric; one row per key.

    A row qualifies by its label (or its own and the next row's, where a label is cut), has three cells or more
    and two or three amounts; tables of quarters don't count. The first two amounts are this and the earlier
    period; the rate is the first percentage, else the first small number. Among several rows those of a main
    table win, then the largest amount, then the first.
    """
    rows = _parsed(df, key, text).where(~F.col("head").contains("季度"))
    score = F.when(F.col("head").contains("主要会计数据"), 2).otherwise(0) + F.when(F.col("head").contains("上年同期"), 1).otherwise(0)
    each = rows.select(key, "unit", "table_no", score.alias("score"), "grid", F.posexplode("grid").alias("row_no", "cells"))
    label = lambda row: F.array_join(F.transform(row, clean_cell), "")
    following = F.coalesce(label(F.try_element_at("grid", F.col("row_no") + 2)), F.lit(""))
    hits = each.select(key, "unit", "table_no", "score", "row_no", "cells", label(F.col("cells")).alias("label"), following.alias("following")).where((F.size("cells") >= 3) & _is_row(F.col("label"), F.col("following"), metric))
    values = F.filter(F.transform("cells", lambda c: F.struct(to_number(c).alias("v"), F.trim(c).endswith("%").alias("pct"))), lambda x: x["v"].isNotNull())
    amounts = F.transform(F.filter("values", lambda x: F.abs(x["v"]) > SMALL), lambda x: x["v"])
    valued = hits.withColumn("values", values).withColumn("amounts", amounts).where(F.size("amounts").between(2, 3))
    first = lambda test: F.try_element_at(F.filter("values", test), F.lit(1))["v"]
    now = F.element_at("amounts", 1)
    rate = F.coalesce(first(lambda x: x["pct"] & (F.abs(x["v"]) <= 10000)), first(lambda x: (F.abs(x["v"]) <= SMALL) & (F.abs(x["v"]) != F.abs(now))))
    found = valued.select(key, "score", "table_no", "row_no", (now * F.col("unit")).alias("now"), (F.element_at("amounts", 2) * F.col("unit")).alias("prev"), rate.alias("pct"))
    best = F.max_by(F.struct("now", "prev", "pct"), F.struct("score", F.abs("now"), -F.col("table_no"), -F.col("row_no")))
    return found.groupBy(key).agg(best.alias("b")).select(key, "b.now", "b.prev", "b.pct")


def yoy(now: Column, prev: Column, pct: Column) -> Column:
    """The rate of change: as stated, else computed where there is an earlier value other than zero."""
    return F.coalesce(pct, F.when(prev != 0, (now / prev - 1) * 100))


def format_yi(value: Column) -> Column:
    """An amount in hundred millions of yuan with two decimals; a dash for null."""
    return F.coalesce(F.concat(F.format_number(value / 1e8, 2), F.lit(" 亿元")), F.lit("—"))


def panorama(results: DataFrame, chunks: DataFrame, metric: str, by_growth: bool = False) -> DataFrame:
    """Companies compared within each question: ``qid``, ``place``, ``code``, ``idx`` (the source), ``now``, ``prev``, ``yoy``.

    ``results`` has ``qid``, ``code``, ``place``, ``idx``; a company's value is taken from its first result in
    which the metric can be read. Companies without a value come last.
    """
    results = cut_lineage(results)
    ids = results.select("idx").distinct()
    values = extract_metric(chunks.select("idx", "text").join(broadcast_if_small(ids, ids.count()), "idx", "left_semi").distinct(), "idx", "text", metric)
    read = results.join(values, "idx", "left")
    first = F.min_by(F.struct("idx", "now", "prev", "pct"), F.struct(F.col("now").isNull().alias("n"), "place"))
    rows = read.groupBy("qid", "code").agg(first.alias("b")).select("qid", "code", "b.idx", "b.now", "b.prev", F.round(yoy(F.col("b.now"), F.col("b.prev"), F.col("b.pct")), 6).alias("yoy"))
    order = ([F.desc_nulls_last("yoy")] if by_growth else []) + [F.desc_nulls_last("now"), F.asc("code")]
    return rows.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(*order))).select("qid", "place", "code", "idx", "now", "prev", "yoy")


def panorama_table(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Companies side by side: ``period``, ``code``, and for ``revenue`` and ``profit`` the ``page`` and ``url`` of the first result, ``now``, ``prev`` and ``yoy``.

    ``results`` has ``id`` (metric and period, joined by a bar), ``code``, ``place``, ``idx``. A metric is read from its company's
    few results joined in order, since a table may be cut between chunks; a company that only one metric has results of
    has nulls for the other.
    """
    ids = results.select("idx").distinct()
    texts = chunks.select("idx", "text", "page_start", "url").join(broadcast_if_small(ids, ids.count()), "idx", "left_semi").distinct()
    held = results.join(texts, "idx").groupBy("id", "code").agg(F.array_sort(F.collect_list(F.struct("place", "idx", "text", "page_start", "url"))).alias("r"))
    merged = cut_lineage(held.select(F.concat_ws("|", "id", "code").alias("key"), "id", "code", F.array_join(F.transform("r", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"), F.col("r")[0]["page_start"].alias("page"), F.col("r")[0]["url"].alias("url")))
    sides = []
    for metric in ("revenue", "profit"):
        own = merged.where(F.split_part("id", F.lit("|"), F.lit(1)) == metric)
        read = own.join(extract_metric(own, "key", "text", metric), "key", "left")
        sides.append(read.select(F.split_part("id", F.lit("|"), F.lit(2)).alias("period"), "code", F.col("page").alias(f"{metric}_page"), F.col("url").alias(f"{metric}_url"), F.col("now").alias(metric), F.col("prev").alias(f"{metric}_prev"), F.round(yoy(F.col("now"), F.col("prev"), F.col("pct")), 6).alias(f"{metric}_yoy")))
    return sides[0].join(sides[1], ["period", "code"], "full_outer")


def entity_growth(facts: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """``entity``, ``period``, ``now``, ``prev`` (of the period before), ``yoy`` and ``place`` within the period by growth."""
    sums = facts.groupBy(entity, period).agg(F.round(F.sum(value), 2).alias("now"))
    before = sums.select(F.col(entity), (F.col(period) + 1).alias(period), F.col("now").alias("prev"))
    both = sums.join(before, [entity, period], "left").withColumn("yoy", F.round(F.when(F.col("prev") != 0, (F.col("now") / F.col("prev") - 1) * 100), 6))
    order = [F.desc_nulls_last("yoy"), F.desc_nulls_last("now"), F.asc(entity)]
    return both.withColumn("place", F.row_number().over(W.partitionBy(period).orderBy(*order)))


def to_markdown(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table; null for fewer than two rows with content.

    Cells lose outer whitespace and line breaks, short rows are padded, and a blank head gives way to the first
    row of the body.
    """
    tidy = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))))
    full = F.filter(tidy, lambda r: F.exists(r, lambda c: c != ""))
    wide = F.array_max(F.transform(full, lambda r: F.size(r)))
    padded = F.transform(full, lambda r: F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), wide))
    body = F.transform(F.slice(padded, F.lit(2), F.greatest(F.size(padded) - 1, F.lit(0))), line)
    return F.when(F.size(full) >= 2, F.array_join(F.concat(F.array(line(F.element_at(padded, 1)), rule), body), "\n"))

