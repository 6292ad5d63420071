"""The SQL that checks the core queries: each operator's meaning stated again for DuckDB."""

from __future__ import annotations

from ledgerlens.functions.text import NARROW, WIDE
from ledgerlens.functions.vocabulary import ALIASES, ALPHA, EXPANSIONS, HALF_YEAR, HEADER_NOISE, K1, METRIC_QUERIES, B

_HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
_RUNS = rf"[{_HAN}\x{{F900}}-\x{{FAFF}}]+|[a-z0-9][a-z0-9.%,]*|[\x{{C0}}-\x{{24F}}]+"
_WIDE, _NARROW = WIDE.replace("'", "''"), NARROW.replace("'", "''")
_EDGE = r"'^[\s　]+|[\s　]+$', '', 'g'"


def _folded(text: str) -> str:
    return f"lower(translate({text}, '{_WIDE}', '{_NARROW}'))"


def _term_list(text: str) -> str:
    one = f"CASE WHEN regexp_matches(r, '^[{_HAN}]') THEN list_concat(list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)), list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) ELSE [r] END"
    return f"flatten(list_transform(regexp_extract_all({_folded(text)}, '{_RUNS}'), lambda r: {one}))"


_TOKENS = f"""docs AS (SELECT DISTINCT idx, concat_ws(' ', nullif(section, ''), nullif(subsection, ''), nullif(text, '')) AS body FROM chunks WHERE idx IS NOT NULL),
toks AS (SELECT idx, {_term_list("body")} AS terms FROM docs),
words AS (SELECT idx, unnest(terms) AS term FROM toks),
tf AS (SELECT term, idx, count(*) AS tf FROM words GROUP BY ALL),
dl AS (SELECT idx, CAST(len(terms) AS BIGINT) AS dl FROM toks)"""
_GAPS = f"""{_TOKENS},
gaps AS (SELECT term, idx, idx - coalesce(lag(idx) OVER (PARTITION BY term, idx >> 12 ORDER BY idx), (idx >> 12) << 12) AS gap, tf FROM tf),
coded AS (SELECT *, {" + ".join(f"CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 WHEN {x} < 268435456 THEN 4 ELSE 5 END" for x in ("gap", "tf"))} AS bytes FROM gaps)"""


def _expanded(question: str) -> str:
    return f"concat_ws(' ', {question}, " + ", ".join(f"CASE WHEN contains({question}, '{p}') THEN '{w}' END" for p, w in EXPANSIONS) + ")"


_EXPANDED = _expanded("question")
_RULES = " ".join(f"WHEN {' OR '.join(f"contains(q, '{w}')" for w in words)} THEN '{wording}'" for words, wording in METRIC_QUERIES)
_HALF = " OR ".join(f"contains(question, '{w}')" for w in HALF_YEAR)
_SHORT = " ".join(f"WHEN contains(question, '{short}') THEN '{code}'" for short, code in ALIASES)
_NUMBER = "CAST(regexp_extract(id, '[0-9]+') AS BIGINT)"
_FILTERS = f"""asked AS (SELECT DISTINCT id, question FROM questions),
filters AS (SELECT id, coalesce((SELECT min(c.code) FROM companies c WHERE contains(question, c.name) OR contains(question, c.code)), CASE {_SHORT} END) AS code,
  CASE WHEN {_HALF} THEN 'H1' WHEN regexp_matches(question, '20[0-9][0-9]') THEN regexp_extract(question, '20[0-9][0-9]') || 'A' END AS period FROM asked),
have AS (SELECT DISTINCT idx, code, period FROM chunks WHERE idx IS NOT NULL)"""


def _used(filters: str, name: str) -> str:
    return f"""{name}_n AS (SELECT f.id, f.code, f.period, (SELECT count(*) FROM have h WHERE (f.code IS NULL OR h.code = f.code) AND (f.period IS NULL OR contains(h.period, f.period))) AS allowed FROM {filters} f),
{name} AS (SELECT *, CASE WHEN allowed > 0 THEN code END AS use_code, CASE WHEN allowed > 0 THEN period END AS use_period FROM {name}_n)"""


# The filter of each stated question: what is given, else what its words ask for if nothing is given and detection is on.
_FORCE = f"""{_FILTERS},
given AS (SELECT DISTINCT id, code, period, auto_filter FROM questions WHERE {_NUMBER} % 20 = 0),
chosen AS (SELECT DISTINCT g.id, CASE WHEN g.code IS NULL AND g.period IS NULL AND auto_filter THEN f.code ELSE g.code END AS code, CASE WHEN g.code IS NULL AND g.period IS NULL AND auto_filter THEN f.period ELSE g.period END AS period FROM given g JOIN filters f USING (id)),
{_used("chosen", "force")}"""
_MET = "(use_code IS NULL OR h.code = use_code) AND (use_period IS NULL OR contains(h.period, use_period))"


def _bm25(stated: str) -> str:
    """``stated`` is a statement with id and expanded."""
    return f"""{_TOKENS},
stated AS ({stated}),
wanted AS (SELECT DISTINCT id, unnest({_term_list("expanded")}) AS term FROM stated),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
scores AS (SELECT id, idx, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))), 6) AS bm25
  FROM tf JOIN df USING (term) JOIN wanted USING (term) JOIN dl USING (idx), stats GROUP BY id, idx)"""


_BM25 = _bm25(f"SELECT DISTINCT id, {_EXPANDED} AS expanded FROM questions WHERE {_NUMBER} % 20 = 0")
_COSINE = "round(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(v.embedding[i] AS DOUBLE))), 6)"


def _scale(x: str, over: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 0 WHEN max({x}) OVER w <= min({x}) OVER w THEN 1.0 ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END".replace("OVER w", f"OVER (PARTITION BY {over})")


def _searched(name: str, dense: bool = True) -> str:
    """Both channels of the stated questions over the chunks that the filter ``name`` allows, and their joint score over each question."""
    cos = f"SELECT f.id, h.idx, h.code, {_COSINE} AS cos FROM {name} f JOIN (SELECT DISTINCT * FROM embeddings) q ON q.vec_id = CAST(regexp_extract(f.id, '[0-9]+') AS BIGINT) JOIN have h ON {_MET} JOIN (SELECT DISTINCT * FROM embeddings) v ON v.vec_id = h.idx" if dense else f"SELECT id, CAST(NULL AS BIGINT) AS idx, '' AS code, CAST(NULL AS DOUBLE) AS cos FROM {name} WHERE false"
    return f"""sparse AS (SELECT s.id, s.idx, h.code, s.bm25 FROM scores s JOIN have h USING (idx) JOIN {name} f ON f.id = s.id WHERE {_MET}),
dense AS ({cos}),
sides AS (SELECT coalesce(s.id, d.id) AS id, coalesce(s.idx, d.idx) AS idx, coalesce(s.code, d.code) AS code, bm25, cos FROM sparse s FULL JOIN dense d ON d.id = s.id AND d.idx = s.idx),
whole AS (SELECT *, round({ALPHA} * ({_scale("cos", "id")}) + {1 - ALPHA} * ({_scale("bm25", "id")}), 6) AS score FROM sides)"""


def _top(side: str, score: str) -> str:
    return f"""WITH {_BM25}, {_FORCE}, {_searched("force")},
best AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY score DESC, idx) AS rank, idx, score, bm25, cos FROM (SELECT id, idx, {score} AS score, bm25, cos FROM whole WHERE {side}) QUALIFY rank <= 8)
SELECT b.id, b.rank, b.idx, c.code, c.period, c.section, c.page_start, c.type, round(b.score, 4) AS score, round(coalesce(b.bm25, 0), 3) AS bm25, round(coalesce(b.cos, 0), 4) AS cos
FROM best b JOIN (SELECT DISTINCT idx, code, period, section, page_start, type FROM chunks) c USING (idx)"""


def _groups(stated: str, name: str, dense: bool = True) -> str:
    """Three chunks of every company for each row of ``stated``: from the wide search, else from a search of its own."""
    return f"""{_bm25(stated)}, {_searched(name, dense)},
wide AS (SELECT greatest(3 * count(DISTINCT code) * 4, 64) AS wide FROM companies),
head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, idx) AS r FROM whole), wide WHERE r <= wide AND code IS NOT NULL),
first AS (SELECT id, code, row_number() OVER (PARTITION BY id, code ORDER BY score DESC, idx) AS place, idx, score FROM head QUALIFY place <= 3),
rest AS (SELECT id, idx, code, round({ALPHA} * ({_scale("cos", "id, code")}) + {1 - ALPHA} * ({_scale("bm25", "id, code")}), 6) AS score FROM sides s WHERE code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM first f WHERE f.id = s.id AND f.code = s.code)),
second AS (SELECT id, code, row_number() OVER (PARTITION BY id, code ORDER BY score DESC, idx) AS place, idx, score FROM rest QUALIFY place <= 3),
grouped AS (SELECT *, 'wide' AS source FROM first UNION ALL SELECT *, 'own' FROM second)"""


# Stated questions as ones about all companies: only the stated period filters.
_PERIODS = f"""{_FILTERS}, every AS (SELECT DISTINCT id, CAST(NULL AS VARCHAR) AS code, period FROM questions WHERE {_NUMBER} % 20 = 0), {_used("every", "force")}"""
_ALL_COMPANIES = f"""{_PERIODS}, {_groups(f"SELECT DISTINCT id, {_expanded('m')} AS expanded FROM (SELECT id, CASE {_RULES} ELSE q END AS m FROM (SELECT id, regexp_replace(question, '^\\s*全景\\s*[:：]?\\s*', '') AS q FROM questions WHERE {_NUMBER} % 20 = 0))", "force")}"""
_CHANNELS = """channels AS (SELECT qid, idx, max(CASE WHEN NOT isnan(bm25) THEN bm25 END) AS bm25, max(CASE WHEN NOT isnan(cos) THEN cos END) AS cos, bool_or(gold) AS gold, max(lpad(regexp_extract(code, '[0-9]+'), 6, '0')) AS code
  FROM retrieved WHERE qid IS NOT NULL AND idx IS NOT NULL GROUP BY qid, idx)"""


def _scaled(c: str) -> str:
    lo, hi = f"min({c}) OVER (PARTITION BY qid)", f"max({c}) OVER (PARTITION BY qid)"
    return f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN {hi} <= {lo} THEN 1.0 ELSE ({c} - {lo}) / ({hi} - {lo}) END END"


_FUSED = f"""{_CHANNELS},
scaled AS (SELECT *, {_scaled("bm25")} AS bm25_norm, {_scaled("cos")} AS cos_norm FROM channels),
joint AS (SELECT *, round({ALPHA} * coalesce(cos_norm, 0) + {1 - ALPHA} * coalesce(bm25_norm, 0), 6) AS fused FROM scaled),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, idx) AS rank FROM joint)"""
_GROUPED = f"""{_FUSED},
own AS (SELECT qid, code, idx, fused, row_number() OVER (PARTITION BY qid, code ORDER BY fused DESC, idx) AS place FROM joint WHERE code IS NOT NULL)"""
_BEST = f"""{_FUSED},
asked AS (SELECT DISTINCT id AS qid, question FROM questions WHERE id IS NOT NULL),
texts AS (SELECT DISTINCT idx, name, code, period, title, section, subsection, page_start, page_end, type, text FROM chunks WHERE idx IS NOT NULL),
best AS (SELECT p.qid, p.rank, q.question, t.* FROM placed p JOIN asked q USING (qid) JOIN texts t ON t.idx = p.idx)"""
_PAGES = """pages AS (SELECT key, page, coalesce(text, '') AS text FROM report_pages WHERE key IS NOT NULL AND page IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY key, page ORDER BY extracted_at DESC, coalesce(text, '') DESC) = 1)"""
_LINES = f"""{_PAGES},
cut AS (SELECT key, page, string_split(text, chr(10)) AS l FROM pages),
lines AS (SELECT key, page, generate_subscripts(l, 1) - 1 AS seq, regexp_replace(unnest(l), {_EDGE}) AS line FROM cut)"""
_SECTION = "^\\s*第\\s*[一二三四五六七八九十百]+\\s*节"
_SPLIT = r"'(^|¦)(-?[\d,]+\.)¦(\d{1,2})(¦|$)', '\1\2\3\4', 'g'"
_TEXTS = "texts AS (SELECT DISTINCT idx, text FROM chunks WHERE idx IS NOT NULL)"
_BLOCKS = r"""blocked AS (SELECT idx, regexp_matches(coalesce(text, ''), '单位\s*[:：]\s*(?:人民币)?\s*万元') AS wan, regexp_extract_all(coalesce(text, ''), '(?m)(?:^[ \t]*\|[^\n]*(?:\n|\z))+') AS b FROM texts),
blocks AS (SELECT idx, wan, generate_subscripts(b, 1) - 1 AS table_no, unnest(b) AS block FROM blocked),
kept AS (SELECT idx, wan, table_no, list_filter(string_split(block, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_full_match(trim(x), '[|\-:\s]*')) AS k FROM blocks),
raw AS (SELECT idx, wan, table_no, generate_subscripts(k, 1) - 1 AS row_no, array_to_string(list_transform(string_split(regexp_replace(trim(unnest(k)), '^\||\|$', '', 'g'), '|'), lambda c: trim(c)), '¦') AS joined FROM kept),
rows AS (SELECT idx, wan, table_no, row_no, string_split(regexp_replace(regexp_replace(joined, """ + _SPLIT + "), " + _SPLIT + "), '¦') AS cells FROM raw)"


def _metric(name: str, test: str) -> str:
    return f"""SELECT idx, '{name}' AS metric, now, prev, pct, round(coalesce(pct, CASE WHEN prev <> 0 THEN (now / prev - 1) * 100 END), 6) AS yoy FROM (
  SELECT idx, table_no, row_no, score, amounts[1] * unit AS now, amounts[2] * unit AS prev,
    coalesce(list_filter(vals, lambda v: v.p AND abs(v.x) <= 10000)[1].x, list_filter(vals, lambda v: abs(v.x) <= 1000 AND abs(v.x) <> abs(amounts[1]))[1].x) AS pct
  FROM (SELECT *, list_transform(list_filter(vals, lambda v: abs(v.x) > 1000), lambda v: v.x) AS amounts FROM valued WHERE len(cells) >= 3 AND ({test}))
  WHERE len(amounts) BETWEEN 2 AND 3
  QUALIFY row_number() OVER (PARTITION BY idx ORDER BY score DESC, abs(amounts[1] * unit) DESC, table_no, row_no) = 1)"""


_READ = f"""{_BLOCKS},
labelled AS (SELECT *, array_to_string(list_transform(cells, lambda c: replace(replace(c, ' ', ''), '　', '')), '') AS label FROM rows),
headed AS (SELECT *, coalesce(lead(label) OVER (PARTITION BY idx, table_no ORDER BY row_no), '') AS following,
  string_agg(CASE WHEN row_no < 3 THEN label ELSE '' END, '') OVER (PARTITION BY idx, table_no) AS head FROM labelled),
valued AS (SELECT *, CASE WHEN wan THEN 10000.0 ELSE 1.0 END AS unit,
  CASE WHEN contains(head, '主要会计数据') THEN 2 ELSE 0 END + CASE WHEN contains(head, '上年同期') THEN 1 ELSE 0 END AS score,
  list_transform(list_filter(list_transform(cells, lambda c: replace(replace(c, ' ', ''), '　', '')), lambda c: regexp_full_match(c, '-?[\\d,]*\\d[\\d,]*(\\.\\d+)?%?')),
    lambda c: {{'x': CAST(replace(replace(c, ',', ''), '%', '') AS DOUBLE), 'p': ends_with(c, '%')}}) AS vals
  FROM headed WHERE NOT contains(head, '季度')),
found AS ({_metric("revenue", "regexp_matches(label, '营业收入|营业总收入') AND NOT regexp_matches(label, '成本|构成|比重|占比|明细|分产品')")}
  UNION ALL {_metric("profit", "contains(label, '归属于上市公司股东') AND NOT contains(label, '扣除非经常性损益') AND (contains(label, '净利润') OR (contains(following, '净利润') AND NOT contains(following, '扣除非经常性损益')))")})"""
_METRIC = f"{_TEXTS}, {_READ}"
_RECALL = f"""{_FUSED},
recalls AS (SELECT qid, min(CASE WHEN gold THEN rank END) AS first FROM placed GROUP BY qid),
judged AS (SELECT qid, first, coalesce(first <= 8, false) AS recalled, CASE WHEN first <= 8 THEN 'ok' WHEN first IS NOT NULL THEN 'part' ELSE 'bad' END AS verdict FROM recalls),
everyone AS (SELECT a.qid, j.verdict, j.recalled FROM (SELECT DISTINCT id AS qid FROM questions WHERE id IS NOT NULL) a LEFT JOIN judged j USING (qid))"""
_LATEST = """latest AS (SELECT * FROM reports WHERE key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY fetched_at DESC NULLS LAST, code DESC NULLS LAST, name DESC NULLS LAST, exchange DESC NULLS LAST, period DESC NULLS LAST, kind DESC NULLS LAST, title DESC NULLS LAST, url DESC NULLS LAST, announcement_date DESC NULLS LAST, file DESC NULLS LAST, bytes DESC NULLS LAST) = 1)"""
_MANIFEST = f"""{_LATEST},
own AS (SELECT concat_ws('_', code, period) AS key, count(*) AS chunks, count(*) FILTER (type = 'table') AS tables, sum(coalesce(length(text), 0)) AS chars
  FROM (SELECT DISTINCT idx, code, period, type, text FROM chunks WHERE idx IS NOT NULL) GROUP BY 1),
counted AS (SELECT key, count(DISTINCT page) AS pages FROM report_pages WHERE key IS NOT NULL AND page IS NOT NULL GROUP BY key),
manifest AS (SELECT l.key, l.name, CASE l.exchange WHEN 'szse' THEN '深圳证券交易所' WHEN 'sse' THEN '上海证券交易所' WHEN 'bse' THEN '北京证券交易所' ELSE l.exchange END AS exchange,
  CASE l.kind WHEN 'annual' THEN '年度报告' WHEN 'semi' THEN '半年度报告' ELSE l.kind END AS kind, CAST(coalesce(o.chunks, 0) AS BIGINT) AS chunks, CAST(coalesce(o.tables, 0) AS BIGINT) AS tables, CAST(coalesce(o.chars, 0) AS BIGINT) AS chars, CAST(coalesce(c.pages, 0) AS BIGINT) AS pages
  FROM latest l LEFT JOIN own o USING (key) LEFT JOIN counted c USING (key))"""
_QUESTION_TERMS = f"list_filter(list_distinct({_term_list('question')}), lambda t: length(t) > 1 OR NOT regexp_matches(t, '[a-z0-9]'))"
_KEY_LINES = f"""{_BEST},
cut AS (SELECT qid, question, idx, rank, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, {_EDGE})), lambda x: x <> '' AND NOT starts_with(x, '| ---') AND NOT regexp_matches(x, '^\\|?\\s*-{{2,}}')) AS l FROM best WHERE rank <= 3),
each AS (SELECT qid, question, idx, generate_subscripts(l, 1) AS seq, unnest(l) AS line FROM cut),
hit AS (SELECT *, len(list_intersect({_QUESTION_TERMS}, list_distinct({_term_list("line")}))) - CASE WHEN NOT regexp_matches(question, '扣非|扣除非经常性损益') AND contains(regexp_replace(line, '[\\s　]+', '', 'g'), '扣除非经常性损益') THEN 3 ELSE 0 END AS hits FROM each)"""


def _best_vectors(stored: str, divide: str) -> str:
    dot = f"round(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * {stored})){divide}, 6)"
    return f"""SELECT * FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY cos DESC, item) AS rank, item, cos FROM (
  SELECT q.vec_id AS query, v.vec_id AS item, {dot} AS cos FROM (SELECT DISTINCT * FROM embeddings) q, (SELECT DISTINCT * FROM embeddings) v WHERE q.vec_id % 20 = 0)) WHERE rank <= 10"""


def _byte(x: str) -> str:
    return f"greatest(-127, least(127, round_even(CAST({x} AS DOUBLE) * 127, 0)))"


_FACTS = "facts AS (SELECT DISTINCT id, unnest(list_filter([" + ", ".join(f"CASE WHEN contains(question, '{p}') THEN {{'n': {n}, 'any_of': [{', '.join(f"'{x}'" for x in dict.fromkeys([p, *w.split(' ')]))}]}} END" for n, (p, w) in enumerate(EXPANSIONS, 1)) + "], lambda x: x IS NOT NULL)) AS f FROM questions WHERE id IS NOT NULL)"


def _squeezed(text: str) -> str:
    return f"regexp_replace(coalesce({text}, ''), '[\\s　]+', '', 'g')"


_HELD = f"""{_BEST}, {_FACTS},
scope AS (SELECT DISTINCT id, code, period FROM questions WHERE id IS NOT NULL),
results AS (SELECT b.qid AS id, b.rank, b.idx, {_squeezed("b.text")} AS plain, b.text, coalesce((s.code IS NULL OR b.code = s.code) AND (s.period IS NULL OR contains(b.period, s.period)), false) AS fits FROM best b JOIN scope s ON s.id = b.qid WHERE b.rank <= 8)"""
_HITS = f"""{_HELD},
ranks AS (SELECT f.id, f.f.n AS n, min(r.rank) AS hit_rank FROM facts f JOIN results r ON r.id = f.id WHERE fits AND len(list_filter(f.f.any_of, lambda p: contains(plain, p))) > 0 GROUP BY 1, 2),
used AS (SELECT id, {_squeezed("string_agg(substr(coalesce(text, ''), 1, 2500), '' ORDER BY rank)")} AS answer FROM results WHERE rank <= 3 GROUP BY id),
hits AS (SELECT f.id, f.f.n AS fact_no, r.hit_rank, r.hit_rank IS NOT NULL AS recalled, coalesce(len(list_filter(f.f.any_of, lambda p: contains(answer, p))) > 0, false) AS covered FROM facts f LEFT JOIN ranks r ON r.id = f.id AND r.n = f.f.n LEFT JOIN used u ON u.id = f.id)"""
_JUDGED = f"""{_HITS},
own AS (SELECT id, count(*) FILTER (recalled) AS recall_hits, count(*) AS facts, count(*) FILTER (covered) AS coverage_hits, min(hit_rank) AS gold_rank, bool_and(recalled) AS gold_recalled FROM hits GROUP BY id),
build AS (SELECT *, round(recall_hits / facts, 3) AS recall_rate, round(coverage_hits / facts, 3) AS coverage_rate,
  CASE {_NUMBER} % 4 WHEN 0 THEN '正确：口径一致' WHEN 1 THEN '部分正确' WHEN 2 THEN '错误' END AS verdict, CASE {_NUMBER} % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'part' ELSE 'bad' END AS class FROM own)"""


_SUB = "^\\s*(?:[一二三四五六七八九十]+\\s*[、.．]|（[一二三四五六七八九十]+）|\\d+\\s*[、.．]\\s*\\S|\\d+\\.\\d+\\s*\\S)"
_NUMBERED = "regexp_full_match({0}, '\\d{{1,4}}(\\s*/\\s*\\d{{1,4}})?') AND (abs(TRY_CAST(regexp_extract({0}, '^(\\d{{1,4}})', 1) AS INTEGER) - page) <= 1 OR coalesce(abs(TRY_CAST(regexp_extract({0}, '/\\s*(\\d{{1,4}})$', 1) AS INTEGER) - page) <= 1, false))"
# Page text as lines, blank lines and tables in order, without boilerplate and page numbers.
_STREAM = f"""{_LINES}, sizes AS (SELECT key, count(DISTINCT page) AS n FROM pages GROUP BY key),
boiler AS (SELECT key, line FROM lines JOIN sizes USING (key) WHERE line <> '' AND length(line) < 40 GROUP BY key, line HAVING count(DISTINCT page) > max(n) * 0.3),
split AS (SELECT key, page, string_split(regexp_replace(text, '\\[表格开始\\]\\n((?s:.*?))\\n\\[表格结束\\]', chr(1) || chr(2) || '\\1' || chr(1), 'g'), chr(1)) AS s FROM pages),
parts AS (SELECT key, page, generate_subscripts(s, 1) - 1 AS seq, unnest(s) AS part FROM split),
piece AS (SELECT key, page, seq, starts_with(part, chr(2)) AS is_table, CASE WHEN starts_with(part, chr(2)) THEN [substr(part, 2)] ELSE string_split(part, chr(10)) END AS l FROM parts WHERE part <> ''),
cell AS (SELECT key, page, seq, is_table, generate_subscripts(l, 1) AS line_no, regexp_replace(unnest(l), {_EDGE}) AS content FROM piece),
stream AS (SELECT *, CASE WHEN is_table THEN 'table' WHEN content = '' THEN 'blank' ELSE 'line' END AS kind FROM cell c WHERE is_table OR content = '' OR NOT ({_NUMBERED.format("content")} OR EXISTS (SELECT 1 FROM boiler b WHERE b.key = c.key AND b.line = c.content)))"""
_CAPTIONS = f"""WITH {_STREAM},
counted AS (SELECT *, count(*) FILTER (kind = 'line') OVER (PARTITION BY key ORDER BY page, seq, line_no ROWS UNBOUNDED PRECEDING) AS no FROM stream WHERE kind <> 'blank'),
fit AS (SELECT *, last_value(CASE WHEN kind = 'line' AND length(content) BETWEEN 3 AND 40 AND NOT regexp_matches(content, '[。，；]$') THEN {{'no': no, 'line': content}} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY page, seq, line_no ROWS UNBOUNDED PRECEDING) AS hit FROM counted)
SELECT key, page, CAST(seq AS INTEGER) AS seq, CASE WHEN hit.no > no - 4 THEN hit.line ELSE '' END AS caption FROM fit WHERE kind = 'table'"""
# The chunker as a recursion over each report's events: the open buffer starts at ``start`` and has ``size`` characters.
_CHUNKED = f"""WITH RECURSIVE {_STREAM},
solid AS (SELECT *, kind = 'line' AND length(content) <= 60 AND regexp_matches(content, '{_SECTION}') AS heading, lead(CASE WHEN kind = 'line' THEN content END) OVER (PARTITION BY key ORDER BY page, seq, line_no) AS after FROM stream WHERE kind <> 'blank'),
wants AS (SELECT *, coalesce(heading AND length(regexp_replace(regexp_replace(content, '{_SECTION}', ''), {_EDGE})) < 2 AND length(after) < 40, false) AS takes, row_number() OVER (PARTITION BY key ORDER BY page, seq, line_no) AS n FROM solid),
chain(key, n, takes) AS (SELECT key, n, takes FROM wants WHERE n = 1 UNION ALL SELECT w.key, w.n, w.takes AND NOT c.takes FROM chain c JOIN wants w ON w.key = c.key AND w.n = c.n + 1),
named AS (SELECT w.key, page, seq, line_no, CASE WHEN c.takes THEN content || ' ' || after ELSE content END AS content, CASE WHEN heading THEN 'section' WHEN kind = 'line' AND length(content) < 50 AND regexp_matches(content, '{_SUB}') THEN 'sub' ELSE kind END AS kind
  FROM wants w JOIN chain c ON c.key = w.key AND c.n = w.n WHERE NOT EXISTS (SELECT 1 FROM chain p WHERE p.key = w.key AND p.n = w.n - 1 AND p.takes)),
joined AS (SELECT * FROM named UNION ALL SELECT key, page, seq, line_no, content, kind FROM stream WHERE kind = 'blank' UNION ALL SELECT key, max(page), 2147483647, 0, '', 'end' FROM pages GROUP BY key),
events AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page, seq, line_no) AS pos FROM joined),
fold(key, pos, start, size, no, text_from, text_no, table_from, table_no) AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM events
  UNION ALL
  SELECT key, pos, CASE WHEN enough AND kind = 'line' AND own < 300 THEN pos WHEN enough OR kind IN ('section', 'table', 'end') THEN NULL ELSE start END,
    CASE WHEN enough AND kind = 'line' AND own < 300 THEN own WHEN enough OR kind IN ('section', 'table', 'end') THEN 0 ELSE size END,
    no + CAST(enough AS BIGINT) + CAST(kind = 'table' AS BIGINT), CASE WHEN enough THEN start END, CASE WHEN enough THEN no + 1 END,
    CASE WHEN kind = 'table' THEN CASE WHEN enough THEN pos ELSE coalesce(start, pos) END END, CASE WHEN kind = 'table' THEN no + 1 + CAST(enough AS BIGINT) END
  FROM (SELECT e.key, e.pos, e.kind, f.no, length(e.content) AS own, CASE WHEN e.kind = 'line' THEN coalesce(f.start, e.pos) ELSE f.start END AS start, f.size + CASE WHEN e.kind = 'line' THEN length(e.content) ELSE 0 END AS size,
      f.size + CASE WHEN e.kind = 'line' THEN length(e.content) ELSE 0 END >= CASE e.kind WHEN 'line' THEN 1100 WHEN 'blank' THEN 700 WHEN 'table' THEN 200 WHEN 'end' THEN 120 ELSE 220 END AS enough
    FROM fold f JOIN events e ON e.key = f.key AND e.pos = f.pos + 1)),
cuts AS (SELECT key, text_no AS no, text_from AS a, pos AS b, false AS is_table FROM fold WHERE text_no IS NOT NULL UNION ALL SELECT key, table_no, table_from, pos, true FROM fold WHERE table_no IS NOT NULL),
bodies AS (SELECT c.key, c.no, c.b, c.is_table, string_agg(e.content, chr(10) ORDER BY e.pos) AS text, min(e.page) AS first, max(e.page) AS last, max(CASE WHEN e.kind = 'table' THEN length(e.content) - length(replace(e.content, chr(10), '')) + 1 END) AS rows
  FROM cuts c JOIN events e ON e.key = c.key AND e.pos BETWEEN c.a AND c.b AND (e.kind = 'line' OR c.is_table AND e.kind = 'table') GROUP BY ALL),
label AS (SELECT b.*, (SELECT arg_max(content, pos) FROM events e WHERE e.key = b.key AND e.pos < b.b AND kind = 'section') AS section, coalesce((SELECT max(pos) FROM events e WHERE e.key = b.key AND e.pos < b.b AND kind = 'section'), 0) AS since FROM bodies b),
recent AS (SELECT l.key, l.no, e.content, row_number() OVER (PARTITION BY l.key, l.no ORDER BY e.pos DESC) AS back FROM label l JOIN events e ON e.key = l.key AND e.pos >= l.since AND e.pos < l.b AND e.kind IN ('section', 'sub', 'line') WHERE is_table),
title AS (SELECT key, no, arg_min(content, back) AS caption FROM recent WHERE back <= 4 AND length(content) BETWEEN 3 AND 40 AND NOT regexp_matches(content, '[。，；]$') GROUP BY key, no)
SELECT format('{{}}#{{:04d}}', l.key, l.no) AS id, l.key, coalesce(section, '') AS section, coalesce((SELECT arg_max(content, pos) FROM events e WHERE e.key = l.key AND e.pos < l.b AND e.pos > l.since AND kind = 'sub'), '') AS subsection, CASE WHEN is_table THEN last ELSE first END AS page_start, last AS page_end,
  CASE WHEN is_table THEN 'table' ELSE 'text' END AS type, CAST(CASE WHEN is_table THEN rows END AS INTEGER) AS table_rows, CASE WHEN is_table THEN coalesce(caption, '') END AS table_caption, text, CAST(length(text) AS INTEGER) AS n_chars
FROM label l LEFT JOIN title t ON t.key = l.key AND t.no = l.no"""
_MARKED = f"""WITH {_BEST},
asking AS (SELECT *, {_term_list("question")} AS said FROM best WHERE rank <= 8),
words AS (SELECT qid, idx, text, list_transform(list_sort(list_transform(list_filter(list_filter(said, lambda t, i: list_position(said, t) = i), lambda t: length(t) > 1), lambda t, i: {{'n': -length(t), 'i': i, 't': t}})), lambda x: x.t)[1:40] AS w FROM asking)
SELECT qid, idx, list_reduce(list_concat([replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')], w), lambda acc, t: replace(acc, t, '<mark>' || t || '</mark>')) AS marked FROM words"""


def _pairs(text: str, line: str) -> str:
    """A table row as pairs of head and value, up to 240 characters; other lines as they are."""
    cells = lambda x: f"list_transform(string_split(regexp_replace(trim({x}), '^\\||\\|$', '', 'g'), '|'), lambda c: trim(c))"
    noise = ", ".join(f"'{x}'" for x in HEADER_NOISE)
    lines = f"list_transform(string_split({text}, chr(10)), lambda c: trim(c))"
    at = f"list_position({lines}, trim({line}))"
    gap = f"coalesce(list_max(list_transform(range(1, {at}), lambda k: CASE WHEN NOT starts_with({lines}[k], '|') THEN k END)), 0)"
    head = cells(f"{lines}[{gap} + 1]")
    pair = f"list_transform(range(1, len({cells(line)}) + 1), lambda k: CASE WHEN {cells(line)}[k] <> '' THEN CASE WHEN {head}[k] IS NOT NULL AND {head}[k] <> {cells(line)}[k] AND {head}[k] <> '' AND NOT list_contains([{noise}], {head}[k]) THEN {head}[k] || '：' || {cells(line)}[k] ELSE {cells(line)}[k] END END)"
    return f"CASE WHEN starts_with(trim({line}), '|') AND {at} > 0 THEN substr(array_to_string(list_filter({pair}, lambda x: x IS NOT NULL), '；'), 1, 240) ELSE {line} END"


_ANSWERS = f"""WITH {_KEY_LINES},
top AS (SELECT qid, idx, line, row_number() OVER (PARTITION BY qid, idx ORDER BY hits * 1000 + least(length(line), 300) DESC, seq) AS place FROM hit WHERE hits > 0 QUALIFY place <= 2),
told AS (SELECT b.qid, b.idx, string_agg({_pairs("b.text", "t.line")}, '；' ORDER BY place) AS told FROM best b JOIN top t ON t.qid = b.qid AND t.idx = b.idx WHERE b.rank <= 3 GROUP BY 1, 2),
spare AS (SELECT qid, rank, idx, text, CASE WHEN type = 'table' AND len(list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x), '|'))) > 0 THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x), '|'))[1:2], ' ') ELSE string_split(text, chr(10))[1] END AS line FROM best WHERE rank <= 3)
SELECT s.qid, CAST(s.rank AS INTEGER) AS citation, s.idx, substr(coalesce(t.told, {_pairs("s.text", "s.line")}), 1, 240) AS answer FROM spare s LEFT JOIN told t ON t.qid = s.qid AND t.idx = s.idx"""


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def statements(literal: dict[str, list[tuple]]) -> dict[str, str]:
    """DuckDB statements by query name."""
    bars = "list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x), '|'))"
    safe = "replace(replace(replace(trim(c), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    row = lambda x, tag: f"'<tr>' || array_to_string(list_transform(string_split(regexp_replace(trim({x}), '^\\||\\|$', '', 'g'), '|'), lambda c: '<{tag}>' || {safe} || '</{tag}>'), '') || '</tr>'"
    found = {
        "token_counts": f"WITH {_TOKENS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term",
        "doc_lengths": f"WITH {_TOKENS} SELECT idx, dl FROM dl",
        "corpus_stats": f"WITH {_TOKENS} SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) AS terms, round(avg(dl), 6) AS avgdl FROM dl",
        "term_idf": f"WITH {_TOKENS}, c AS (SELECT count(*) AS n FROM dl) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), c",
        "posting_blocks": f"WITH {_TOKENS} SELECT term, idx >> 12 AS block, count(*) AS n, string_agg(idx || ':' || tf, ' ' ORDER BY idx) AS postings FROM tf WHERE term IN (SELECT term FROM tf GROUP BY term HAVING count(*) >= 2) GROUP BY 1, 2",
        "delta_encode": f"WITH {_GAPS} SELECT term, idx, gap, tf, CAST(bytes AS BIGINT) AS bytes FROM coded",
        "delta_decode": f"WITH {_TOKENS} SELECT term, idx, idx AS decoded FROM tf",
        "posting_offsets": f"WITH {_GAPS}, s AS (SELECT term, count(*) AS df, CAST(sum(bytes) AS BIGINT) AS bytes FROM coded GROUP BY term) SELECT *, CAST(coalesce(sum(bytes) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM s",
        "company_codes": "SELECT name AS value, row_number() OVER (ORDER BY name) - 1 AS code FROM (SELECT DISTINCT name FROM chunks WHERE name IS NOT NULL)",
        "section_codes": "SELECT section AS value, row_number() OVER (ORDER BY first, section) - 1 AS code FROM (SELECT section, min(idx) AS first FROM chunks WHERE section IS NOT NULL AND idx IS NOT NULL GROUP BY section)",
        "dict_encode": "WITH c AS (SELECT DISTINCT idx, name, section FROM chunks WHERE idx IS NOT NULL), n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS code FROM (SELECT DISTINCT name FROM c WHERE name IS NOT NULL)), s AS (SELECT section, row_number() OVER (ORDER BY first, section) - 1 AS code FROM (SELECT section, min(idx) AS first FROM c WHERE section IS NOT NULL GROUP BY section)) SELECT c.idx, n.code AS name, s.code AS section FROM c LEFT JOIN n USING (name) LEFT JOIN s USING (section)",
        "embed_text": "SELECT DISTINCT idx, substr(concat_ws(' ', nullif(name, ''), nullif(period, ''), nullif(section, ''), nullif(subsection, '')) || chr(10) || coalesce(text, ''), 1, 1500) AS body FROM chunks WHERE idx IS NOT NULL",
        "query_expand": f"SELECT DISTINCT id, {_EXPANDED} AS expanded FROM questions WHERE id IS NOT NULL",
        "metric_query": f"SELECT DISTINCT id, CASE {_RULES} ELSE q END AS reduced FROM (SELECT id, regexp_replace(question, '^\\s*全景\\s*[:：]?\\s*', '') AS q FROM questions WHERE id IS NOT NULL)",
        "filter_detect": f"WITH {_FILTERS} SELECT id, code, period FROM filters",
        "filter_fallback": f"WITH {_FILTERS}, {_used('filters', 'used')} SELECT * FROM used",
        "bm25_topk": f"WITH {_BM25} SELECT id, idx, bm25, row_number() OVER (PARTITION BY id ORDER BY bm25 DESC, idx) AS rank FROM scores QUALIFY rank <= 10",
        "bm25_stored": f"WITH {_BM25} SELECT id, idx, bm25, row_number() OVER (PARTITION BY id ORDER BY bm25 DESC, idx) AS rank FROM scores QUALIFY rank <= 10",
        "bm25_filtered": f"WITH {_BM25}, {_FORCE} SELECT s.id, s.idx, s.bm25, row_number() OVER (PARTITION BY s.id ORDER BY bm25 DESC, s.idx) AS rank FROM scores s JOIN have h USING (idx) JOIN force u ON u.id = s.id WHERE {_MET} QUALIFY rank <= 10",
        "search_hybrid": _top("true", "score"),
        "search_bm25": _top("bm25 IS NOT NULL", f"round({_scale('bm25', 'id')}, 6)").replace("round(coalesce(b.cos, 0), 4) AS cos", "CAST(0 AS DOUBLE) AS cos"),
        "search_dense": _top("cos IS NOT NULL", f"round({_scale('cos', 'id')}, 6)").replace("round(coalesce(b.bm25, 0), 3) AS bm25", "CAST(0 AS DOUBLE) AS bm25"),
        "search_grouped": f"WITH {_ALL_COMPANIES} SELECT id, code, CAST(place AS INTEGER) AS place, idx, score, source FROM grouped",
        "panorama_table": f"""WITH {_PERIODS}, wording(metric, q) AS (VALUES ('revenue', '{METRIC_QUERIES[0][1]}'), ('profit', '{METRIC_QUERIES[1][1]}')),
pseudo AS (SELECT DISTINCT metric || '|' || coalesce(period, '') AS id, {_expanded("q")} AS expanded, use_code, use_period FROM force, wording),
{_groups("SELECT id, expanded FROM pseudo", "pseudo", False)},
texts AS (SELECT id || '|' || code AS idx, string_agg(coalesce(text, ''), chr(10) ORDER BY place) AS text FROM grouped g JOIN (SELECT DISTINCT idx, text, page_start, url FROM chunks) c ON c.idx = g.idx GROUP BY 1),
places AS (SELECT g.id || '|' || g.code AS idx, page_start, url FROM grouped g JOIN (SELECT DISTINCT idx, text, page_start, url FROM chunks) c ON c.idx = g.idx WHERE place = 1),
{_READ},
side AS (SELECT string_split(t.idx, '|')[1] AS metric, string_split(t.idx, '|')[2] AS period, string_split(t.idx, '|')[3] AS code, p.page_start AS page, p.url, f.now, f.prev, f.yoy FROM texts t JOIN places p ON p.idx = t.idx LEFT JOIN found f ON f.idx = t.idx AND f.metric = string_split(t.idx, '|')[1])
SELECT coalesce(r.period, p.period) AS period, coalesce(r.code, p.code) AS code, r.page AS revenue_page, r.url AS revenue_url, r.now AS revenue, r.prev AS revenue_prev, r.yoy AS revenue_yoy, p.page AS profit_page, p.url AS profit_url, p.now AS profit, p.prev AS profit_prev, p.yoy AS profit_yoy
FROM (SELECT * FROM side WHERE metric = 'revenue') r FULL JOIN (SELECT * FROM side WHERE metric = 'profit') p ON p.period = r.period AND p.code = r.code""",
        "cosine_topk": _best_vectors("CAST(v.embedding[i] AS DOUBLE)", ""),
        "int8_cosine": _best_vectors(_byte("v.embedding[i]"), " / 127"),
        "vector_norm": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings",
        "quantize": f"SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(CAST({_byte('x')} AS INTEGER) AS VARCHAR)), ' ') AS codes FROM embeddings",
        "minmax": f"WITH {_FUSED} SELECT qid, idx, round(bm25_norm, 6) AS bm25_norm, round(cos_norm, 6) AS cos_norm FROM scaled",
        "hybrid_search": f"WITH {_FUSED} SELECT qid, rank, idx, fused FROM placed WHERE rank <= 8",
        "search_modes": f"WITH {_FUSED}, long AS (SELECT qid, idx, 'bm25' AS mode, round(bm25_norm, 6) AS score FROM joint UNION ALL SELECT qid, idx, 'dense', round(cos_norm, 6) FROM joint UNION ALL SELECT qid, idx, 'hybrid', fused FROM joint) SELECT mode, qid, row_number() OVER (PARTITION BY mode, qid ORDER BY score DESC, idx) AS rank, idx, score FROM long WHERE score IS NOT NULL QUALIFY rank <= 8",
        "channel_ranks": f"WITH {_CHANNELS}, a AS (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, idx) AS bm25_place FROM channels WHERE bm25 IS NOT NULL), b AS (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, idx) AS cos_place FROM channels WHERE cos IS NOT NULL) SELECT qid, idx, bm25_place, cos_place FROM a FULL JOIN b USING (qid, idx)",
        "topn_per_group": f"WITH {_GROUPED} SELECT qid, code, place, idx, fused, 'exact' AS source FROM own WHERE place <= 3",
        "grouped_wide_fallback": f"WITH {_GROUPED}, head AS (SELECT qid, code, idx, fused, row_number() OVER (PARTITION BY qid, code ORDER BY fused DESC, idx) AS place FROM (SELECT qid, code, idx, fused FROM joint WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY fused DESC, idx) <= (SELECT greatest(3 * count(DISTINCT code) * 4, 64) FROM companies))) SELECT qid, code, place, idx, fused, 'wide' AS source FROM head WHERE place <= 3 UNION ALL SELECT qid, code, place, idx, fused, 'fallback' FROM own WHERE place <= 3 AND (qid, code) NOT IN (SELECT qid, code FROM head)",
        "panorama_rank": f"WITH {_GROUPED}, {_METRIC}, pick AS (SELECT o.qid, o.code, o.idx, f.now, f.prev, f.yoy FROM own o LEFT JOIN (SELECT * FROM found WHERE metric = 'revenue') f USING (idx) WHERE o.place <= 3 QUALIFY row_number() OVER (PARTITION BY o.qid, o.code ORDER BY f.now IS NULL, o.place) = 1) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY now DESC NULLS LAST, code) AS place, code, idx, now, prev, yoy FROM pick",
        "entity_growth": "WITH s AS (SELECT n_name AS entity, CAST(year(o_orderdate) AS INTEGER) AS period, round(sum(o_totalprice), 2) AS now FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), b AS (SELECT s.*, p.now AS prev, round(CASE WHEN p.now <> 0 THEN (s.now / p.now - 1) * 100 END, 6) AS yoy FROM s LEFT JOIN s p ON p.entity = s.entity AND p.period = s.period - 1) SELECT *, row_number() OVER (PARTITION BY period ORDER BY yoy DESC NULLS LAST, now DESC NULLS LAST, entity) AS place FROM b",
        "growth_rank": f"WITH {_GROUPED}, {_METRIC}, pick AS (SELECT o.qid, o.code, o.idx, f.now, f.prev, f.yoy FROM own o LEFT JOIN (SELECT * FROM found WHERE metric = 'profit') f USING (idx) WHERE o.place <= 3 QUALIFY row_number() OVER (PARTITION BY o.qid, o.code ORDER BY f.now IS NULL, o.place) = 1) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY yoy DESC NULLS LAST, now DESC NULLS LAST, code) AS place, code, idx, now, prev, yoy FROM pick",
        "markdown_tables": f"WITH {_TEXTS}, {_BLOCKS} SELECT idx, table_no, row_no, array_to_string(cells, '¦') AS cells FROM rows",
        "metric_extract": f"WITH {_METRIC} SELECT *, coalesce(format('{{:,.2f}} 亿元', now / 1e8), '—') AS shown FROM found",
        "boilerplate_filter": f"WITH {_LINES}, n AS (SELECT key, count(DISTINCT page) AS pages FROM pages GROUP BY key) SELECT key, line, on_pages FROM (SELECT key, line, count(DISTINCT page) AS on_pages FROM lines WHERE line <> '' AND length(line) < 40 GROUP BY key, line) JOIN n USING (key) WHERE on_pages > pages * 0.3",
        "page_number_filter": f"WITH {_LINES} SELECT key, page, seq, line FROM lines WHERE regexp_full_match(line, '\\d{{1,4}}(\\s*/\\s*\\d{{1,4}})?') AND (abs(CAST(regexp_extract(line, '^(\\d{{1,4}})', 1) AS INTEGER) - page) <= 1 OR abs(TRY_CAST(regexp_extract(line, '/\\s*(\\d{{1,4}})$', 1) AS INTEGER) - page) <= 1)",
        "section_carry_forward": f"WITH {_LINES} SELECT key, page, seq, coalesce(last_value(CASE WHEN regexp_matches(line, '{_SECTION}') AND length(line) <= 60 THEN line END IGNORE NULLS) OVER (PARTITION BY key ORDER BY page, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM lines WHERE line <> ''",
        "section_titles": f"WITH {_LINES}, f AS (SELECT *, coalesce({', '.join(f'nullif(lead(line, {k}) OVER (PARTITION BY key ORDER BY page, seq), {chr(39) * 2})' for k in (1, 2, 3))}) AS following FROM lines) SELECT key, page, seq, CASE WHEN length(trim(regexp_replace(line, '{_SECTION}', ''))) < 2 AND length(following) < 40 AND NOT regexp_matches(following, '{_SECTION}') THEN line || ' ' || following ELSE line END AS title FROM f WHERE regexp_matches(line, '{_SECTION}') AND length(line) < 60",
        "page_segments": f"WITH {_PAGES}, p AS (SELECT key, page, unnest(string_split(regexp_replace(text, '\\[表格开始\\]\\n((?s:.*?))\\n\\[表格结束\\]', chr(1) || chr(2) || '\\1' || chr(1), 'g'), chr(1))) AS part FROM pages) SELECT key, page, CASE WHEN starts_with(part, chr(2)) THEN 'table' ELSE 'text' END AS kind, CASE WHEN starts_with(part, chr(2)) THEN regexp_replace(substr(part, 2), {_EDGE}) ELSE part END AS content FROM p WHERE part <> ''",
        "line_overlap_rank": f"WITH {_KEY_LINES} SELECT qid, idx, row_number() OVER (PARTITION BY qid, idx ORDER BY hits * 1000 + least(length(line), 300) DESC, seq) AS place, line, hits FROM hit WHERE hits > 0 QUALIFY place <= 2",
        "llm_context": f"WITH {_BEST} SELECT qid, string_agg('[' || rank || '] ' || concat_ws('｜', coalesce(name, ''), coalesce(title, ''), concat_ws(' / ', nullif(section, ''), nullif(subsection, '')), '第 ' || coalesce(page_start || CASE WHEN page_end > page_start THEN '-' || page_end ELSE '' END, '') || ' 页') || chr(10) || substr(coalesce(text, ''), 1, 1800), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM best WHERE rank <= 8 GROUP BY qid",
        "gold_containment": "WITH p AS (SELECT DISTINCT item_id, regexp_replace(expected, '[\\s　]+', '', 'g') AS p FROM eval_items), t AS (SELECT DISTINCT doc_id, regexp_replace(text, '[\\s　]+', '', 'g') AS t FROM documents) SELECT DISTINCT item_id, doc_id FROM p, t WHERE p <> '' AND contains(t, p)",
        "recall_at_k": f"WITH {_RECALL} SELECT * FROM judged",
        "recall_summary": f"WITH {_RECALL} SELECT count(*) AS questions, count(verdict) AS answered, CAST(coalesce(sum(CAST(recalled AS INTEGER)), 0) AS BIGINT) AS recalled, round(coalesce(sum(CAST(recalled AS INTEGER)), 0) / count(*), 3) AS rate FROM everyone",
        "verdict_summary": f"WITH {_RECALL} SELECT coalesce(verdict, 'bad') AS verdict, count(*) AS n FROM everyone GROUP BY 1",
        "coverage": f"WITH {_CHANNELS}, t AS (SELECT count(DISTINCT code) AS total FROM companies) SELECT qid, count(DISTINCT code) AS hit, any_value(total) AS total, round(count(DISTINCT code) / any_value(total), 3) AS coverage FROM channels, t WHERE code IS NOT NULL GROUP BY qid",
        "missing_companies": f"WITH {_CHANNELS} SELECT q.qid, c.code FROM (SELECT DISTINCT qid FROM channels) q, (SELECT DISTINCT code FROM companies WHERE code IS NOT NULL) c WHERE NOT EXISTS (SELECT 1 FROM channels x WHERE x.qid = q.qid AND x.code = c.code)",
        "metadata_upsert": f"WITH {_LATEST} SELECT key, code, name, period, kind, url, bytes, announcement_date FROM latest",
        "report_pick": "WITH r AS (SELECT code, title, announcement_date, regexp_extract(title, '(20\\d{2})\\s*年(?:年度|半年度)?报告', 1) AS year, CASE WHEN contains(title, '半年度报告') THEN 'semi' ELSE 'annual' END AS kind FROM reports WHERE code IS NOT NULL AND NOT regexp_matches(title, '摘要|英文|意见|说明|专项|补充|更正|公告|H股|港股|海外')), n AS (SELECT code, kind, year || CASE kind WHEN 'semi' THEN 'H1' ELSE 'A' END AS tag, announcement_date, title FROM r WHERE year <> '' QUALIFY row_number() OVER (PARTITION BY code, kind, tag ORDER BY announcement_date DESC, title DESC) = 1) SELECT code, kind, tag, row_number() OVER (PARTITION BY code, kind ORDER BY announcement_date DESC NULLS LAST, tag DESC) AS place, title FROM n QUALIFY place <= CASE kind WHEN 'semi' THEN 1 ELSE 2 END",
        "manifest_rows": f"WITH {_MANIFEST} SELECT * FROM manifest",
        "manifest_totals": f"WITH {_MANIFEST} SELECT count(DISTINCT name) AS companies, count(*) AS reports, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(tables) AS BIGINT) AS tables, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(pages) AS BIGINT) AS pages FROM manifest",
        "chunk_stats": "SELECT count(*) AS chunks, round(sum(n) / greatest(count(*), 1), 1) AS mean_chars, count(*) FILTER (type = 'table') AS tables FROM (SELECT DISTINCT idx, type, coalesce(length(text), 0) AS n FROM chunks WHERE idx IS NOT NULL)",
        "report_urls": "SELECT DISTINCT key, 'http://static.example/' || ltrim(regexp_replace(regexp_replace(url, '^[A-Za-z]*:?//', ''), '^[^/]*\\.[^/]*/', ''), '/') AS address, substr(sha256(file), 1, 16) AS digest FROM reports WHERE key IS NOT NULL",
        "nfkc_tokens": f"SELECT DISTINCT id, array_to_string({_term_list('question')}, ' ') AS tokens FROM questions WHERE id IS NOT NULL",
        "table_captions": _CAPTIONS,
        "report_chunks": _CHUNKED,
        "highlight": _MARKED,
        "extractive_answer": _ANSWERS,
        # Token numbers: start, end, unknown, then characters from U+4E00, digits, digits inside a number, marks.
        "wordpiece_ids": f"""WITH w AS (SELECT DISTINCT id, regexp_extract_all(question, '[{_HAN}\\x{{F900}}-\\x{{FAFF}}]|[\\p{{P}}$+<=>^`|~]|[^\\s　{_HAN}\\x{{F900}}-\\x{{FAFF}}\\p{{P}}$+<=>^`|~]+') AS w FROM questions WHERE id IS NOT NULL),
n AS (SELECT id, flatten(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '[\\x{{4E00}}-\\x{{9FFF}}]') THEN [3 + ord(x) - 19968] WHEN length(x) = 1 AND instr('，。？：、', x) > 0 THEN [21014 + instr('，。？：、', x)]
  WHEN regexp_full_match(x, '[0-9]+') THEN list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i = 1 THEN 20995 ELSE 21005 END + CAST(substr(x, i, 1) AS INTEGER)) ELSE [2] END)) AS n FROM w)
SELECT id, array_to_string(list_transform(list_concat([0], n[1:510], [1]), lambda x: CAST(x AS VARCHAR)), ' ') AS ids FROM n""",
        "question_facts": f"WITH {_FACTS} SELECT id, f.n AS fact_no, unnest(f.any_of) AS pattern FROM facts",
        "gold_results": f"WITH {_HELD} SELECT r.id, r.rank, r.idx, fits AND coalesce((SELECT bool_or(len(list_filter(f.f.any_of, lambda p: contains(plain, p))) > 0) FROM facts f WHERE f.id = r.id), false) AS gold FROM results r",
        "fact_hits": f"WITH {_HITS} SELECT * FROM hits",
        "eval_build": f"WITH {_JUDGED} SELECT id, recall_hits, facts, coverage_hits, gold_rank, gold_recalled, recall_rate, coverage_rate, verdict, class FROM build",
        "eval_summary": f"WITH {_JUDGED} SELECT count(*) AS questions, CAST(sum(recall_hits) AS BIGINT) AS recall_hits, CAST(sum(coverage_hits) AS BIGINT) AS coverage_hits, CAST(sum(facts) AS BIGINT) AS facts, count(*) FILTER (class = 'ok') AS correct, count(*) FILTER (class = 'part') AS partial, count(*) FILTER (class = 'bad') AS wrong, round(sum(recall_hits) / sum(facts), 3) AS recall_rate, round(sum(coverage_hits) / sum(facts), 3) AS coverage_rate FROM build",
        "panorama_recall": f"""WITH {_ALL_COMPANIES}, facts AS (SELECT DISTINCT id, unnest([{{'n': 1, 'any_of': ['营业收入', '营收']}}, {{'n': 2, 'any_of': ['归属于上市公司股东的净利润', '归母净利润']}}]) AS f FROM every), {_METRIC},
each AS (SELECT g.id, f.f.n AS fact_no, g.code, bool_or(len(list_filter(f.f.any_of, lambda p: contains({_squeezed("t.text")}, p))) > 0 OR (place = 1 AND EXISTS (SELECT 1 FROM found m WHERE m.idx = g.idx AND m.metric = CASE WHEN len(list_filter(f.f.any_of, lambda p: contains(p, '净利'))) > 0 THEN 'profit' WHEN len(list_filter(f.f.any_of, lambda p: contains(p, '营业'))) > 0 THEN 'revenue' END))) AS hit
  FROM grouped g JOIN texts t ON t.idx = g.idx JOIN facts f ON f.id = g.id GROUP BY ALL)
SELECT id, fact_no, count(*) FILTER (hit) AS companies_hit, count(*) AS companies_total, bool_and(hit) AS recalled FROM each GROUP BY 1, 2""",
        "question_union": "SELECT DISTINCT id, question, CASE WHEN extra THEN 'extra' ELSE 'regular' END AS list FROM questions WHERE id IS NOT NULL AND extra IS NOT NULL",
        "first_names": "SELECT code, name FROM chunks WHERE code IS NOT NULL AND idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY idx, name) = 1",
        "site_stats": f"WITH {_TOKENS} SELECT count(*) AS chunks, count(*) FILTER (type = 'table') AS tables, CAST(sum(n) AS BIGINT) AS chars, (SELECT count(*) FROM (SELECT DISTINCT key, page FROM report_pages WHERE key IS NOT NULL AND page IS NOT NULL)) AS pages, (SELECT count(*) FROM (SELECT term FROM tf GROUP BY term HAVING count(*) >= 2)) AS terms FROM (SELECT DISTINCT idx, type, coalesce(length(text), 0) AS n FROM chunks WHERE idx IS NOT NULL)",
        "dict_decode": "SELECT DISTINCT idx, name, section FROM chunks WHERE idx IS NOT NULL",
        "fetch_changes": "WITH r AS (SELECT DISTINCT key, fetched_at, bytes FROM reports WHERE bytes IS NOT NULL AND key IS NOT NULL), a AS (SELECT key, bytes FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY fetched_at NULLS FIRST, bytes) = 1), b AS (SELECT key, bytes FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY fetched_at DESC NULLS LAST, bytes DESC) = 1) SELECT key, 'bytes' AS \"column\" FROM a JOIN b USING (key) WHERE abs(a.bytes - b.bytes) > 1",
        "fetch_dates": "SELECT DISTINCT key, strftime(fetched_at, '%Y-%m-%d') AS date FROM reports WHERE key IS NOT NULL AND fetched_at IS NOT NULL",
        "page_digests": f"WITH {_PAGES} SELECT key, page, substr(sha256(text), 1, 16) AS digest FROM pages",
        "table_markdown": f"""WITH {_TEXTS}, {_BLOCKS},
tidy AS (SELECT idx, table_no, row_no, list_transform(cells, lambda c: trim(regexp_replace(c, '[\\s　]+', ' ', 'g'))) AS cells FROM rows),
solid AS (SELECT *, max(len(cells)) OVER (PARTITION BY idx, table_no) AS wide, row_number() OVER (PARTITION BY idx, table_no ORDER BY row_no) AS n FROM tidy WHERE len(list_filter(cells, lambda c: c <> '')) > 0),
lines AS (SELECT idx, table_no, n, wide, '| ' || array_to_string(list_resize(cells, wide, ''), ' | ') || ' |' || CASE WHEN n = 1 THEN chr(10) || '|' || repeat(' --- |', CAST(wide AS INTEGER)) ELSE '' END AS line FROM solid)
SELECT idx, CAST(table_no AS INTEGER) AS table_no, string_agg(line, chr(10) ORDER BY n) AS markdown FROM lines GROUP BY idx, table_no HAVING count(*) >= 2""",
        "unit_vectors": "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: format('{:.6f}', round((CAST(x AS DOUBLE) * 3) / n * CAST(0.7301 AS DOUBLE), 6) + 0.0)), ' ') AS codes FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) * 3) * (CAST(x AS DOUBLE) * 3)))) AS n FROM embeddings) UNION ALL SELECT -1, '0.000000 0.000000 0.000000 0.000000'",
        "literal_terms": f"WITH {_values('strings', 'id, text', literal['strings'])} SELECT CAST(id AS BIGINT) AS id, array_to_string({_term_list('text')}, ' ') AS tokens FROM strings",
        "literal_split_numbers": f"WITH {_values('chunks', 'idx, text', literal['chunks'])}, {_TEXTS}, {_BLOCKS} SELECT CAST(idx AS BIGINT) AS idx, CAST(table_no AS INTEGER) AS table_no, CAST(row_no AS INTEGER) AS row_no, array_to_string(cells, '¦') AS cells FROM rows",
        "literal_metrics": f"WITH {_values('chunks', 'idx, text', literal['chunks'])}, {_METRIC} SELECT CAST(idx AS BIGINT) AS idx, metric, now, prev, yoy FROM found",
        "literal_layout": f"WITH {_values('blocks', 'key, page, x0, y0, x1, y1, kind, text, seq', literal['blocks'])}, {_values('boxes', 'key, page, x0, y0, x1, y1', literal['boxes'])} SELECT key, CAST(page AS INTEGER) AS page, string_agg(text, chr(10) ORDER BY y0, seq) AS text FROM blocks b WHERE kind = 'text' AND trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM boxes t WHERE t.key = b.key AND t.page = b.page AND (b.x0 + b.x1) / 2 BETWEEN t.x0 - 2 AND t.x1 + 2 AND (b.y0 + b.y1) / 2 BETWEEN t.y0 - 2 AND t.y1 + 2) GROUP BY 1, 2",
        "table_html": f"SELECT DISTINCT idx, '<table class=\"md-table\"><thead>' || {row("b[1]", "th")} || '</thead><tbody>' || array_to_string(list_transform(b[3:], lambda x: {row("x", "td")}), '') || '</tbody></table>' AS html FROM (SELECT idx, {bars} AS b FROM chunks WHERE idx IS NOT NULL AND text IS NOT NULL) WHERE len(b) >= 2",
    }
    pages = _values("report_pages", "key, page, text, extracted_at", literal["report_pages"])
    for name, of in (("literal_section_titles", "section_titles"), ("literal_carry_forward", "section_carry_forward")):
        found[name] = found[of].replace("WITH ", f"WITH {pages}, ", 1)
    # Spark's row numbers, sizes and positions are 32-bit integers.
    narrow = {c: names.split() for c, names in (("rank", "bm25_topk bm25_stored bm25_filtered search_hybrid search_bm25 search_dense cosine_topk int8_cosine hybrid_search search_modes gold_results"), ("place", "topn_per_group grouped_wide_fallback panorama_rank growth_rank entity_growth line_overlap_rank report_pick"), ("seq", "page_number_filter section_carry_forward section_titles literal_section_titles literal_carry_forward"), ("page", "literal_section_titles literal_carry_forward"), ("hit_rank", "fact_hits"), ("gold_rank", "eval_build"), ("fact_no", "question_facts fact_hits panorama_recall"), ("hits", "line_overlap_rank"), ("table_no", "markdown_tables"), ("row_no", "markdown_tables"), ("first", "recall_at_k"))}
    for name, sql in found.items():
        columns = [c for c, names in narrow.items() if name in names]
        if columns:
            found[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in columns)}) FROM ({sql})"
    return found
