"""The pN_ queries of the llm operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import NARROW, WIDE
from ledgerlens.llm import ideal_rank, leak, mixing, near_dup, reading, segments, site_lines, term_counts, topn
from ledgerlens.runtime import read_table

SCORES = ["bm25", "cos", "score"]


def six_digits(code: Column) -> Column:
    """A company code in its six-digit form, from forms such as ``SZ098617``, ``098617.SZ``, ``98617`` or `` 098617``; null if there are no digits."""
    digits = F.regexp_extract(code, r"(\d+)", 1)
    return F.when(digits != "", F.lpad(digits, 6, "0"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ideal_rank.leaders(read_table(spark, sf_dir, "retrieved"), "qid", "idx", SCORES, 3)


def p1_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ideal_rank.ideal_rank(read_table(spark, sf_dir, "retrieved"), "qid", "idx", SCORES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "retrieved").select("qid", six_digits(F.col("code")).alias("code"), "idx", "score").where("code is not null and qid is not null")
    return topn.top_n(rows, ["qid", "code"], "idx", "score", 3).select("qid", "code", "idx")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_lines(read_table(spark, sf_dir, "report_pages"), "key", "page", "text").select(F.col("source").alias("key"), "line")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = site_lines.without_repeated_lines(read_table(spark, sf_dir, "report_pages"), "key", "page", "text")
    return cleaned.withColumnsRenamed({"source": "key", "doc": "page"})


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = term_counts.term_counts(read_table(spark, sf_dir, "chunks"), "idx", "text", "section")
    return counts.where("mark is not null").select("field", "term", "mark")


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.term_counts(read_table(spark, sf_dir, "chunks"), "idx", "text", "section")


def _passages(spark: SparkSession, sf_dir: str) -> near_dup.NearDuplicates:
    rows = read_table(spark, sf_dir, "chunks").where("type = 'text'").select("idx", "text")
    return near_dup.NearDuplicates(rows, "idx", "text", threshold=0.7, width=5, unit="char")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).pairs().withColumnsRenamed({"id_a": "idx_a", "id_b": "idx_b"})


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).groups().withColumnRenamed("id", "idx")


def _leak_args(spark: SparkSession, sf_dir: str) -> tuple:
    return read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "expected"


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(*_leak_args(spark, sf_dir)).select("doc_id", "item_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leak_report(*_leak_args(spark, sf_dir))


def p8_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.scrub(*_leak_args(spark, sf_dir))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.split_oversized(read_table(spark, sf_dir, "chunks"), "idx", "text", ["page_start"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("piece = 2").select("idx").distinct()


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source", "lang", "title")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.documents(_mixture(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mixture(spark, sf_dir))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "reading_labels")
    model = reading.fit(*reading.labelled_sample(docs, labels, "doc_id", "text", "reading_level", "rater"))
    return reading.reading_levels(docs, model, "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = p10_levels(spark, sf_dir).where("n_chars >= 200 and level in (1, 5)")
    return far.select("doc_id", F.when(F.col("level") == 1, "easy").otherwise("hard").alias("band")).distinct()


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_levels(spark, sf_dir).groupBy("level").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.round(F.avg("difficulty"), 4).alias("difficulty"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_rank, p2_found, p2_pieces, p3_found, p3_groups, p4_found, p6_found, p6_clean, p7_found, p7_counts, p8_found, p8_report, p8_scrub, p9_mixture, p9_shares, p10_found, p10_levels, p10_profile)}


_CLEAN = "CASE WHEN NOT isnan({0}) THEN {0} END"
_WIDE, _NARROW = WIDE.replace("'", "''"), NARROW.replace("'", "''")


def _folded(text: str) -> str:
    return f"lower(translate({text}, '{_WIDE}', '{_NARROW}'))"


def _leaders_sql() -> str:
    clean = ", ".join(f"max({_CLEAN.format(s)}) AS {s}" for s in SCORES)
    places = ", ".join(f"rank() OVER (PARTITION BY qid ORDER BY {s} DESC NULLS LAST) AS {s}_place" for s in SCORES)
    test = " AND ".join(f"{s} IS NOT NULL AND {s}_place <= 3" for s in SCORES)
    return f"SELECT qid, idx FROM (SELECT *, {places} FROM (SELECT qid, idx, {clean} FROM retrieved WHERE qid IS NOT NULL AND idx IS NOT NULL GROUP BY qid, idx)) WHERE {test}"


def _rank_sql() -> str:
    clean = ", ".join(f"max({_CLEAN.format(s)}) AS {s}" for s in SCORES)
    number = ", ".join(f"row_number() OVER (PARTITION BY qid ORDER BY {s} NULLS LAST) AS r_{s}, count({s}) OVER (PARTITION BY qid) AS c_{s}" for s in SCORES)
    limits = ", ".join(f"max({s}) FILTER (r_{s} = greatest(1, ceil(CAST({share} AS DOUBLE) * c_{s}))) AS {end}_{s}" for s in SCORES for end, share in (("lo", ideal_rank.TAIL), ("hi", 1 - ideal_rank.TAIL)))
    cut = ", ".join(f"coalesce(CASE WHEN {s} IS NOT NULL THEN least(greatest({s}, lo_{s}), hi_{s}) - lo_{s} END, 0) AS w_{s}" for s in SCORES)
    norms = ", ".join(f"sqrt(sum(w_{s} * w_{s}) OVER (PARTITION BY qid)) AS n_{s}, max(w_{s}) OVER (PARTITION BY qid) AS m_{s}" for s in SCORES)
    part = lambda here, s: f"pow(CASE WHEN n_{s} > 0 THEN ({here}) / n_{s} ELSE 0 END / {len(SCORES)}, 2)"
    up, down = (f"sqrt({' + '.join(part(here.format(s), s) for s in SCORES)})" for here in ("m_{0} - w_{0}", "w_{0}"))
    return f"""WITH items AS (SELECT qid, idx, {clean} FROM retrieved WHERE qid IS NOT NULL AND idx IS NOT NULL GROUP BY qid, idx),
placed AS (SELECT *, {number} FROM items), limits AS (SELECT qid, {limits} FROM placed GROUP BY qid),
cut AS (SELECT i.qid, i.idx, {cut} FROM items i JOIN limits USING (qid)), scaled AS (SELECT *, {norms} FROM cut),
apart AS (SELECT qid, idx, {up} AS up, {down} AS down FROM scaled),
near AS (SELECT qid, idx, round(CASE WHEN up + down > 0 THEN down / (up + down) ELSE 0.5 END, 9) AS closeness FROM apart)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY closeness DESC, idx) AS rank FROM near"""


def _terms_sql(tail: str) -> str:
    text = _folded("coalesce(text, '')")
    return f"""WITH c AS (SELECT DISTINCT idx, {text} AS t, regexp_replace({_folded("section")}, '[\\s　]+', '', 'g') AS s FROM chunks WHERE idx IS NOT NULL),
pairs AS (SELECT idx, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS term FROM c),
words AS (SELECT idx, unnest(regexp_extract_all(t, '[a-z]{{2,}}')) AS term FROM c),
postings AS (SELECT 'text' AS field, term, idx FROM pairs WHERE regexp_full_match(term, '[\\x{{4E00}}-\\x{{9FFF}}]{{2}}') UNION ALL SELECT 'text', term, idx FROM words UNION ALL SELECT 'section', s, idx FROM c WHERE s <> ''),
counts AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT idx) AS records FROM postings GROUP BY field, term),
n AS (SELECT count(DISTINCT idx) AS n FROM chunks),
marked AS (SELECT field, term, occurrences, records, CASE WHEN records = 1 THEN 'rare' WHEN records > 0.4 * n THEN 'common' END AS mark FROM counts, n)
{tail}"""


def oracle_sql() -> dict[str, str]:
    """DuckDB statements by query name; queries whose method SQL cannot express are tested against plain versions instead."""
    line = "regexp_replace(regexp_replace(regexp_replace(l, '^[\\s　]+|[\\s　]+$', '', 'g'), '[\\s　]+', ' ', 'g'), '[0-9０-９]+', '#', 'g')"

    def plain(text: str) -> str:
        return f"regexp_replace({_folded(text)}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"

    grams = "unnest(list_transform(range(1, greatest(length(t) - 38, 1)), lambda i: substr(t, i, 40)))"
    placed = "generate_subscripts({0}, 1) AS p, unnest({0}) AS g".format("list_transform(range(1, greatest(length(t) - 38, 1)), lambda i: substr(t, i, 40))")
    # Shared spans, from place a up to b in the compared text: runs of neighbouring stretches at the same distance in both texts.
    spans = f"""d AS (SELECT DISTINCT doc_id, text, {plain('text')} AS t, hash(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), e AS (SELECT DISTINCT item_id, {plain('expected')} AS t FROM eval_items),
x AS (SELECT doc_id, h, {placed} FROM d WHERE length(t) >= 40), y AS (SELECT item_id, hash(t) AS k, {placed} FROM e WHERE length(t) >= 40),
m AS (SELECT doc_id, h, item_id, k, x.p - y.p AS apart, x.p FROM x JOIN y USING (g)),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, h, item_id, k, apart ORDER BY p) AS run FROM m),
spans AS (SELECT doc_id, h, item_id, min(p) AS a, max(p) + 40 AS b FROM runs GROUP BY doc_id, h, item_id, k, apart, run)"""
    # The passages, their different five-character stretches, and the shared ones of every pair that has any.
    near = """t AS (SELECT DISTINCT idx, regexp_replace(text, '[\\s　]+', '', 'g') AS t FROM chunks WHERE type = 'text' AND idx IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT idx, unnest(list_transform(range(1, greatest(length(t) - 3, 2)), lambda i: substr(t, i, 5))) AS g FROM t WHERE t <> ''),
n AS (SELECT idx, count(*) AS n FROM g GROUP BY idx),
s AS (SELECT a.idx AS idx_a, b.idx AS idx_b, count(*) AS s FROM g a JOIN g b ON a.g = b.g AND a.idx < b.idx GROUP BY 1, 2),
found AS (SELECT idx_a, idx_b FROM s JOIN n a ON a.idx = idx_a JOIN n b ON b.idx = idx_b WHERE s >= 0.7 * (a.n + b.n - s))"""
    repeated = f"""p AS (SELECT key, page, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM report_pages WHERE key IS NOT NULL AND page IS NOT NULL), c AS (SELECT key, {line} AS line, count(DISTINCT page) AS docs FROM p GROUP BY 1, 2), n AS (SELECT key, count(DISTINCT page) AS pages FROM report_pages GROUP BY key HAVING count(DISTINCT page) >= 5),
repeated AS (SELECT key, line FROM c JOIN n USING (key) WHERE line <> '' AND NOT starts_with(line, '|') AND NOT starts_with(line, '[') AND docs > 0.3 * pages)"""
    return {
        "p1_found": _leaders_sql(),
        "p2_found": "SELECT DISTINCT idx FROM chunks WHERE idx IS NOT NULL AND length(text) > 1100",
        "p1_rank": _rank_sql(),
        "p3_found": f"WITH {near} SELECT * FROM found",
        "p3_groups": f"""WITH RECURSIVE {near},
class AS (SELECT idx, min(idx) OVER (PARTITION BY t) AS rep FROM t WHERE t <> ''),
link AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM found JOIN class a ON a.idx = idx_a JOIN class b ON b.idx = idx_b WHERE a.rep <> b.rep),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT rep AS a, rep AS b FROM class UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT idx, rep, (SELECT min(b) FROM reach WHERE a = rep) AS "group", (SELECT count(*) FROM edge WHERE a = rep) AS links FROM class""",
        "p4_found": f"SELECT qid, code, idx FROM (SELECT qid, lpad(regexp_extract(code, '[0-9]+'), 6, '0') AS code, idx, max({_CLEAN.format('score')}) AS score FROM retrieved WHERE qid IS NOT NULL AND idx IS NOT NULL AND regexp_matches(code, '[0-9]') GROUP BY ALL) WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid, code ORDER BY score DESC, idx) <= 3",
        "p6_found": f"WITH {repeated} SELECT key, line FROM repeated",
        "p6_clean": f"""WITH {repeated}, marks AS (SELECT key, list(line) AS marks FROM repeated GROUP BY key),
d AS (SELECT DISTINCT r.key, CAST(page AS BIGINT) AS page, text, string_split(text, chr(10)) AS l, CASE WHEN page IS NOT NULL THEN coalesce(marks, []) ELSE [] END AS marks FROM report_pages r LEFT JOIN marks m ON m.key = r.key),
k AS (SELECT *, list_filter(l, lambda l: NOT list_contains(marks, {line})) AS kept FROM d)
SELECT key, page, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text, CAST(coalesce(len(l) - len(kept), 0) AS INTEGER) AS removed FROM k""",
        "p7_found": _terms_sql("SELECT field, term, mark FROM marked WHERE mark IS NOT NULL"),
        "p7_counts": _terms_sql("SELECT * FROM marked"),
        "p8_found": f"WITH d AS (SELECT DISTINCT doc_id, {plain('text')} AS t FROM documents WHERE text IS NOT NULL), e AS (SELECT DISTINCT item_id, {plain('expected')} AS t FROM eval_items), x AS (SELECT doc_id, {grams} AS g FROM d WHERE length(t) >= 40), y AS (SELECT DISTINCT item_id, {grams} AS g FROM e WHERE length(t) >= 40) SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g)",
        "p8_report": f"WITH {spans} SELECT item_id, count(DISTINCT doc_id) AS docs, max(b - a) AS longest FROM spans GROUP BY item_id",
        # Spans that touch are one; they go from the place of their first letter or digit in the text to that of their last.
        "p8_scrub": f"""WITH {spans},
before AS (SELECT *, max(b) OVER (PARTITION BY doc_id, h ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM (SELECT DISTINCT doc_id, h, a, b FROM spans)),
numbered AS (SELECT *, count(*) FILTER (done IS NULL OR a > done) OVER (PARTITION BY doc_id, h ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM before),
merged AS (SELECT doc_id, h, min(a) AS a, max(b) AS b FROM numbered GROUP BY doc_id, h, run),
share AS (SELECT doc_id, h, sum(b - a) AS n FROM merged GROUP BY doc_id, h),
held AS (SELECT d.doc_id, d.h, d.text, s.n > 0.5 * length(d.t) AS dropped FROM d JOIN share s ON s.doc_id = d.doc_id AND s.h = d.h),
chars AS (SELECT doc_id, h, generate_subscripts(c, 1) AS i, unnest(c) AS c FROM (SELECT doc_id, h, string_split(text, '') AS c FROM held WHERE NOT dropped)),
counted AS (SELECT *, regexp_matches({_folded("c")}, '[\\p{{L}}\\p{{N}}]') AS counts, count(*) FILTER (regexp_matches({_folded("c")}, '[\\p{{L}}\\p{{N}}]')) OVER (PARTITION BY doc_id, h ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM chars),
gone AS (SELECT m.doc_id, m.h, f.i AS x, l.i AS y FROM merged m JOIN counted f ON f.doc_id = m.doc_id AND f.h = m.h AND f.counts AND f.r = m.a JOIN counted l ON l.doc_id = m.doc_id AND l.h = m.h AND l.counts AND l.r = m.b - 1),
kept AS (SELECT doc_id, h, string_agg(c, '' ORDER BY i) AS text FROM counted k WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = k.doc_id AND g.h = k.h AND k.i BETWEEN g.x AND g.y) GROUP BY doc_id, h)
SELECT e.doc_id, CASE WHEN NOT dropped THEN coalesce(k.text, '') END AS text, length(e.text) - CASE WHEN dropped THEN 0 ELSE length(coalesce(k.text, '')) END AS removed_chars, dropped FROM held e LEFT JOIN kept k ON k.doc_id = e.doc_id AND k.h = e.h""",
    }
