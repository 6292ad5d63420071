"""Quantities in text and tables, recorded in many units, converted to common units in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlens.functions.text import NARROW, WIDE

# The measures, their names in text, their kind and the unit that holds where none is given.
MEASURES = [
    ("营业收入", "revenue", "money"),
    ("营收", "revenue", "money"),
    ("operating revenue", "revenue", "money"),
    ("归属于上市公司股东的净利润", "net_profit", "money"),
    ("归母净利润", "net_profit", "money"),
    ("net profit attributable to shareholders", "net_profit", "money"),
    ("合同负债余额", "contract_liab", "money"),
    ("合同负债", "contract_liab", "money"),
    ("contract liabilities", "contract_liab", "money"),
    ("成品酒产量", "output", "volume"),
    ("成品酒入库量", "output", "volume"),
    ("finished liquor output", "output", "volume"),
    ("原粮采购量", "grain", "mass"),
    ("粮食采购量", "grain", "mass"),
    ("grain purchases", "grain", "mass"),
]

# Units by kind, with the factor and the offset that lead to yuan, litres or kilograms.
UNITS = [
    ("亿元", "money", 100_000_000, 0),
    ("亿", "money", 100_000_000, 0),
    ("百万元", "money", 1_000_000, 0),
    ("万元", "money", 10_000, 0),
    ("千元", "money", 1_000, 0),
    ("元", "money", 1, 0),
    ("billion", "money", 1_000_000_000, 0),
    ("million", "money", 1_000_000, 0),
    ("thousand", "money", 1_000, 0),
    ("万升", "volume", 10_000, 0),
    ("千升", "volume", 1_000, 0),
    ("立方米", "volume", 1_000, 0),
    ("升", "volume", 1, 0),
    ("kl", "volume", 1_000, 0),
    ("kilolitre", "volume", 1_000, 0),
    ("kiloliter", "volume", 1_000, 0),
    ("litre", "volume", 1, 0),
    ("liter", "volume", 1, 0),
    ("万吨", "mass", 10_000_000, 0),
    ("千吨", "mass", 1_000_000, 0),
    ("吨", "mass", 1_000, 0),
    ("公斤", "mass", 1, 0),
    ("千克", "mass", 1, 0),
    ("tonne", "mass", 1_000, 0),
    ("ton", "mass", 1_000, 0),
    ("kilogram", "mass", 1, 0),
    ("kg", "mass", 1, 0),
]

_LABEL = "|".join(sorted((f"(?i:{n})" if n.isascii() else n for n, _, _ in MEASURES), key=len, reverse=True))
_UNIT = "亿元|百万元|万元|千元|元|亿|万升|千升|升|立方米|万吨|千吨|吨|公斤|千克|(?i:kilolit(?:re|er)s?|lit(?:re|er)s?|kl|kilograms?|kg|tonnes?|tons?|billion|million|thousand)"
_MONEY = "百万元|亿元|万元|千元|元"
_DIGITS = r"\d+(?:,\d{3})*(?:\.\d+)?"
_HAN = "[零〇一二两三四五六七八九十百千]+"
_ANY = rf"-?\(?(?:{_DIGITS}|{_HAN})\)? ?(?:{_UNIT})?(?:(?:{_DIGITS}|{_HAN}) ?(?:{_UNIT}))?"
_FILL = r"(?: |\x{3000}|为|达到|达|约|合计|共计|实现|:|(?i:of|rmb|cny|came to|was|were|amounted to|stood at))*"
_VALUE = rf"(-?\(?)(?:({_DIGITS})\)? ?({_UNIT})?|({_HAN})({_UNIT}))(?:({_DIGITS}|{_HAN}) ?({_UNIT}))?( ?%)?"
_BEFORE = rf"(?:[由从](?:上年同期|去年同期)?的?{_ANY}(?:变为|变动至|变动为|变成|增至|增加至|降至|减少至|至|到))?"
_MENTION = rf"({_LABEL}){_BEFORE}{_FILL}{_VALUE}"

#: The regular expressions, in the syntax that both Java and RE2 read.
PATTERNS = {
    "label": rf"(?:{_LABEL})",
    "declared": rf"(?:单位(?:均)?(?:为)?:? ?(?:人民币)?|金额以)(?:{_MONEY})|(?m:^\((?:{_MONEY})\)\s*$)",
    "declared_unit": rf"^(?:单位(?:均)?(?:为)?:? ?(?:人民币)?|金额以|\()({_MONEY})",
    "mention": _MENTION,
    "item": rf"(?m:^\|[^\n]*)|{_MENTION}",
    "row": rf"^\| *(?:{_LABEL}) *(?:\([^|\n]*\))? *\|",
    "row_label": rf"^\| *({_LABEL})",
    "row_unit": rf"^\|[^|]*\(({_UNIT})\)",
    "header": r"(?m)^\|[^\n]*(?:本期|本年|本报告期|(?i:current|this))[^\n]*",
    "now": r"本期|本年|本报告期|(?i:current|this)",
    "not_now": r"上期|上年|去年|同期|增减|变动|(?i:prior|last|change)",
    "in_brackets": rf"\(({_UNIT})\)",
    "cell": rf"^ *{_VALUE} *$",
}


def values(rows: list[tuple]) -> str:
    """Rows as an SQL VALUES list."""
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _han(x: str) -> str:
    """SQL for a Chinese numeral below ten thousand."""

    def digit(pattern: str) -> str:
        return f"(CASE WHEN regexp_extract({x}, '{pattern}', 1) = '' THEN 0 ELSE instr('一二三四五六七八九', replace(regexp_extract({x}, '{pattern}', 1), '两', '二')) END)"

    one = "[一二两三四五六七八九]"
    tens = f"(CASE WHEN regexp_extract({x}, '(^|[零〇百千])十', 0) <> '' THEN 1 ELSE {digit(f'({one})十')} END)"
    return f"1000 * {digit(f'({one})千')} + 100 * {digit(f'({one})百')} + 10 * {tens} + {digit(f'({one})$')}"


def number(x: str) -> str:
    """SQL for a number in digits with thousands commas or in Chinese numerals; null where there is none."""
    return f"(CASE WHEN {x} = '' THEN NULL WHEN regexp_extract({x}, '^[0-9]', 0) <> '' THEN CAST(replace({x}, ',', '') AS DECIMAL(24, 6)) ELSE CAST({_han(x)} AS DECIMAL(24, 6)) END)"


def unit_name(x: str) -> str:
    """SQL for a unit's name in the unit table: lower case, singular; null where there is none."""
    return f"nullif(regexp_replace(lower({x}), 's$', ''), '')"


def figures_sql(dialect: str) -> str:
    """The conversion as one SQL statement over ``chunks(idx, text)``; ``dialect`` is ``spark`` or ``duckdb``."""
    spark = dialect == "spark"
    q = {k: "'" + (v.replace("\\", "\\\\") if spark else v.replace("\\x{3000}", "　")).replace("'", "''") + "'" for k, v in PATTERNS.items()}
    all_of = "regexp_extract_all({}, {}, 0)"
    mark = f"regexp_replace(plain, {q['declared']}, '\\u0001$0')" if spark else f"regexp_replace(plain, {q['declared']}, chr(1) || '\\0', 'g')"
    cut = "split(marked, '\\u0001')" if spark else "string_split(marked, chr(1))"
    wide, narrow = (s.replace("\\", "\\\\").replace("'", "\\'") if spark else s.replace("'", "''") for s in (WIDE + "−－", NARROW + "--"))
    cells = r"split({}, '\\|')" if spark else "string_split({}, '|')"
    at = "element_at" if spark else "list_extract"
    is_now = "c -> c RLIKE {} AND NOT c RLIKE {}" if spark else "lambda c: regexp_matches(c, {}) AND NOT regexp_matches(c, {})"
    place = f"array_position({'transform' if spark else 'list_transform'}({cells.format('header')}, {is_now.format(q['now'], q['not_now'])}), true)"

    def explode(source: str, keep: str, array: str, name: str) -> str:
        if spark:
            return f"SELECT {keep}, pos AS {name}_no, {name} FROM {source} LATERAL VIEW posexplode({array}) AS pos, {name}"
        return f"SELECT {keep}, generate_subscripts({array}, 1) - 1 AS {name}_no, unnest({array}) AS {name} FROM {source}"

    def fields(text: str, pattern: str, shift: int) -> str:
        names = ["sign", "digits", "unit_a", "han", "unit_b", "more", "more_unit", "percent"]
        return ", ".join(f"regexp_extract({text}, {q[pattern]}, {k + shift}) AS {n}" for k, n in enumerate(names))

    has_label = f"text RLIKE {q['label']}" if spark else "true"
    return f"""
WITH measures(name, measure, kind) AS (SELECT * FROM (VALUES {values(MEASURES)}) AS v(name, measure, kind)),
units(unit, kind, factor, shift) AS (SELECT * FROM (VALUES {values(UNITS)}) AS v(unit, kind, factor, shift)),
plain AS (SELECT idx, translate(text, '{wide}', '{narrow}') AS plain FROM {"{chunks}" if spark else "chunks"} WHERE idx IS NOT NULL AND text IS NOT NULL AND {has_label}),
marked AS (SELECT idx, {mark} AS marked FROM plain),
parts AS ({explode("marked", "idx", cut, "part")}),
declared AS (SELECT idx, part_no, part, nullif(regexp_extract(part, {q["declared_unit"]}, 1), '') AS text_unit FROM parts),
headed AS (SELECT *, regexp_extract(part, {q["header"]}, 0) AS header FROM declared),
placed AS (SELECT *, {place} AS place FROM headed),
items AS ({explode("placed", "idx, part_no, text_unit, header, place", all_of.format("part", q["item"]), "item")}),
prose AS (SELECT idx, part_no, item_no, text_unit, lower(regexp_extract(item, {q["mention"]}, 1)) AS name, '' AS label_unit, {fields("item", "mention", 2)} FROM items WHERE item NOT LIKE '|%'),
cells AS (
  SELECT idx, part_no, item_no, text_unit, lower(regexp_extract(item, {q["row_label"]}, 1)) AS name,
    coalesce(nullif(regexp_extract(item, {q["row_unit"]}, 1), ''), regexp_extract({at}({cells.format("header")}, CAST(place AS INT)), {q["in_brackets"]}, 1)) AS label_unit,
    {at}({cells.format("item")}, CAST(place AS INT)) AS cell
  FROM items WHERE item LIKE '|%' AND place > 0 AND regexp_extract(item, {q["row"]}, 0) <> ''),
tabled AS (SELECT idx, part_no, item_no, text_unit, name, label_unit, {fields("cell", "cell", 1)} FROM cells),
read AS (SELECT * FROM prose UNION ALL SELECT * FROM tabled),
numbers AS (
  SELECT idx, part_no, item_no, name, CASE WHEN sign = '' THEN 1 ELSE -1 END AS sign, {number("digits")} AS in_digits, {number("han")} AS in_han, {number("more")} AS more,
    coalesce({unit_name("unit_a")}, {unit_name("unit_b")}) AS own_unit, {unit_name("label_unit")} AS label_unit, text_unit, {unit_name("more_unit")} AS more_unit
  FROM read WHERE percent = '' AND (digits <> '' OR han <> '')),
chosen AS (
  SELECT n.idx, n.part_no, n.item_no, m.measure, m.kind, n.sign, coalesce(n.in_digits, n.in_han) AS amount, n.more, n.more_unit,
    coalesce(n.own_unit, n.label_unit, CASE WHEN m.kind = 'money' THEN n.text_unit END, CASE m.kind WHEN 'money' THEN '元' WHEN 'volume' THEN '升' ELSE '公斤' END) AS unit
  FROM numbers n JOIN measures m ON n.name = m.name),
converted AS (
  SELECT c.idx, c.part_no, c.item_no, c.measure,
    CAST(round(c.sign * (c.amount * u.factor + u.shift + coalesce(c.more * w.factor, 0)), 0) AS BIGINT) AS value
  FROM chosen c JOIN units u ON c.unit = u.unit AND c.kind = u.kind LEFT JOIN units w ON c.more_unit = w.unit AND c.kind = w.kind)
SELECT idx, measure, {"min_by(value, struct(part_no, item_no, value))" if spark else "first(value ORDER BY part_no, item_no, value)"} AS value FROM converted GROUP BY idx, measure
"""


def figures(chunks: DataFrame) -> DataFrame:
    """The current period's figures of ``chunks(idx, text)``: ``idx``, ``measure``, ``value`` in yuan, litres or kilograms.

    One SQL statement: texts are cut where a unit is declared; names with a figure in prose and table rows are taken
    by one regular expression, in the order of the text, rows from the column of the current period; names and units are normalised by joins with
    the fixed tables MEASURES and UNITS. A figure's unit is the one written with it, else that of its row label
    or column head, else the one declared in the text before it, else the base unit. Two-part figures (``1亿300万元``,
    ``5吨20公斤``) are added up; brackets and minus signs are negative; of "from A to B" only B counts; bracketed
    earlier figures and percentages don't count. The fixed tables are of constant size and broadcast; texts are
    never shuffled.

    Defined cases: null and empty texts give no rows, nor do rows without idx; repeated rows count once; of
    several current figures of one measure the first in the text holds (in different texts of one idx, the lower at equal places); cells without a number and units of
    another kind give no row; other columns are ignored.
    """
    statement = figures_sql("spark").replace("{", "{{").replace("}", "}}").replace("{{chunks}}", "{chunks}")
    return chunks.sparkSession.sql(statement, chunks=chunks.select("idx", "text"))
