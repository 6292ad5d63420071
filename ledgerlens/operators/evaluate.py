"""Evaluation of search results, and the bookkeeping of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.functions.text import squeeze
from ledgerlens.functions.vocabulary import EXPANSIONS, NOT_A_REPORT
from ledgerlens.operators.tables import extract_metric
from ledgerlens.runtime import broadcast_if_small, cut_lineage


def recall_at(ranked: DataFrame, k: int) -> DataFrame:
    """``qid``, ``first`` gold rank (null if none), ``recalled`` within ``k``, ``verdict`` ok, part (gold beyond k) or bad. ``ranked`` has ``qid``, ``rank``, ``gold``."""
    first = ranked.groupBy("qid").agg(F.min(F.when(F.col("gold"), F.col("rank"))).alias("first"))
    verdict = F.when(F.col("first") <= k, "ok").when(F.col("first").isNotNull(), "part").otherwise("bad")
    return first.select("qid", "first", F.coalesce(F.col("first") <= k, F.lit(False)).alias("recalled"), verdict.alias("verdict"))


def question_facts(questions: DataFrame) -> DataFrame:
    """``id``, ``fact_no``, ``pattern``: what a good result must mention. Each phrase of EXPANSIONS in a question is a fact, and the phrase or any word of its report wording shows it."""
    rules = [F.when(F.col("question").contains(phrase), F.struct(F.lit(n).alias("fact_no"), F.array(*(F.lit(x) for x in dict.fromkeys([phrase, *wording.split(" ")]))).alias("any_of"))) for n, (phrase, wording) in enumerate(EXPANSIONS, 1)]
    facts = questions.where("id is not null").select("id", "question").distinct().select("id", F.explode(F.array_compact(F.array(*rules))).alias("f"))
    return facts.select("id", "f.fact_no", F.explode("f.any_of").alias("pattern"))


def _in_scope(code: Column, period: Column) -> Column:
    """A result's company and period are those asked for, where any are."""
    return (F.col("asked_code").isNull() | (code == F.col("asked_code"))) & (F.col("asked_period").isNull() | F.contains(period, F.col("asked_period")))


def _scoped(results: DataFrame, questions: DataFrame) -> DataFrame:
    asked = questions.where("id is not null").select("id", F.col("code").alias("asked_code"), F.col("period").alias("asked_period")).distinct()
    return results.join(asked, "id").withColumn("fits", F.coalesce(_in_scope(F.col("code"), F.col("period")), F.lit(False)))


def gold_results(results: DataFrame, facts: DataFrame, questions: DataFrame) -> DataFrame:
    """``id``, ``rank``, ``idx`` and ``gold``: the result is of the company and period asked for and mentions a fact, whitespace not counted."""
    hits = facts.groupBy("id").agg(F.collect_set("pattern").alias("patterns"))
    text = squeeze(F.coalesce("text", F.lit("")))
    joined = _scoped(results, questions).withColumn("plain", text).join(hits, "id", "left")
    some = F.exists(F.coalesce("patterns", F.array().cast("array<string>")), lambda x: F.contains(F.col("plain"), squeeze(x)))
    return joined.select("id", "rank", "idx", (F.col("fits") & some).alias("gold"))


def fact_hits(results: DataFrame, facts: DataFrame, questions: DataFrame, shown: int = 3, chars: int = 2500) -> DataFrame:
    """``id``, ``fact_no``, ``hit_rank`` of the first result in scope that mentions the fact, ``recalled``, and ``covered``: the first ``shown`` results, as far as an answer uses them, mention it.

    ``results`` has ``id``, ``rank``, ``code``, ``period``, ``text``, a few per question; a question without results recalls nothing.
    """
    wanted = facts.groupBy("id", "fact_no").agg(F.collect_set("pattern").alias("patterns"))
    scoped = _scoped(results, questions).select("id", "rank", "fits", squeeze(F.coalesce("text", F.lit(""))).alias("plain"))
    some = lambda text: F.exists("patterns", lambda x: F.contains(text, squeeze(x)))
    ranks = scoped.where("fits").join(wanted, "id").where(some(F.col("plain"))).groupBy("id", "fact_no").agg(F.min("rank").alias("hit_rank"))
    used = results.where(F.col("rank") <= shown).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text")))).alias("used"))
    answer = squeeze(F.array_join(F.transform("used", lambda x: x["text"]), "\n")).alias("answer")
    told = wanted.join(ranks, ["id", "fact_no"], "left").join(used.select("id", answer), "id", "left")
    return told.select("id", "fact_no", "hit_rank", F.col("hit_rank").isNotNull().alias("recalled"), F.coalesce(some(F.col("answer")), F.lit(False)).alias("covered"))


def evaluation(hits: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row per question with facts: ``id``, ``recall_hits``, ``facts``, ``recall_rate``, ``coverage_hits``, ``coverage_rate``, ``gold_rank`` (best of its facts), ``gold_recalled`` (all of them), and the people's ``verdict`` and ``class``."""
    own = hits.groupBy("id").agg(F.count_if("recalled").alias("recall_hits"), F.count("*").alias("facts"), F.count_if("covered").alias("coverage_hits"), F.min("hit_rank").alias("gold_rank"), F.bool_and("recalled").alias("gold_recalled"))
    rated = own.withColumn("recall_rate", rate(F.col("recall_hits"), F.col("facts"))).withColumn("coverage_rate", rate(F.col("coverage_hits"), F.col("facts")))
    return with_annotations(rated, annotations).drop("expected", "analysis")


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """One row: questions, recalled and covered facts with their rates, and questions by verdict class."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = rows.agg(F.count("*").alias("questions"), total("recall_hits"), total("coverage_hits"), total("facts"), *(F.count_if(F.col("class") == c).alias(name) for c, name in (("ok", "correct"), ("part", "partial"), ("bad", "wrong"))))
    return sums.withColumn("recall_rate", rate(F.col("recall_hits"), F.col("facts"))).withColumn("coverage_rate", rate(F.col("coverage_hits"), F.col("facts")))


def company_hits(results: DataFrame, facts: DataFrame, parsed: DataFrame) -> DataFrame:
    """For questions about all companies: ``id``, ``fact_no``, ``companies_hit``, ``companies_total``, ``recalled`` (all of them).

    ``results`` has ``id``, ``code``, ``place``, ``idx``, ``text``. A company is hit if one of its results mentions the fact, or if the
    fact's metric can be read from its first result: ``parsed`` has ``idx``, ``metric`` of the chunks where that is so.
    """
    wanted = facts.groupBy("id", "fact_no").agg(F.collect_set("pattern").alias("patterns"))
    profit, revenue = (F.exists("patterns", lambda x: F.contains(x, F.lit(w))) for w in ("净利", "营业"))
    wanted = wanted.withColumn("metric", F.when(profit, "profit").when(revenue, "revenue"))
    both = results.select("id", "code", "place", "idx", squeeze(F.coalesce("text", F.lit(""))).alias("plain")).join(wanted, "id")
    read = both.join(parsed.select("idx", "metric", F.lit(True).alias("read")), ["idx", "metric"], "left")
    hit = F.exists("patterns", lambda x: F.contains(F.col("plain"), squeeze(x))) | ((F.col("place") == 1) & F.coalesce("read", F.lit(False)))
    each = read.groupBy("id", "fact_no", "code").agg(F.max(hit).alias("hit"))
    return each.groupBy("id", "fact_no").agg(F.count_if("hit").alias("companies_hit"), F.count("*").alias("companies_total")).withColumn("recalled", F.col("companies_hit") == F.col("companies_total"))


def chunk_facts(chunks: DataFrame, patterns: dict[int, tuple[str, ...]]) -> DataFrame:
    """``idx``, ``mentioned`` and ``read``: of each chunk the facts that its text mentions, and those whose metric can be read from it; chunks without any are left out.

    For facts that all questions share: a text is looked at once, where it stands, and only the facts' numbers move on.
    """
    texts = chunks.where("idx is not null").select("idx", "text")
    plain = squeeze(F.coalesce("text", F.lit("")))
    numbers = lambda cases: F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in cases)))
    metric = {n: next((m for m, w in (("profit", "净利"), ("revenue", "营业")) if any(w in p for p in some)), None) for n, some in patterns.items()}
    fact = F.explode(numbers((n, F.exists(F.array(*(squeeze(F.lit(p)) for p in some)), lambda x: F.contains("plain", x))) for n, some in patterns.items())).alias("fact_no")
    rows = texts.select("idx", plain.alias("plain")).select("idx", fact, F.lit(False).alias("read"))
    for n, m in metric.items():
        if m is not None:
            rows = rows.unionByName(extract_metric(texts, "idx", "text", m).select("idx", F.lit(n).alias("fact_no"), F.lit(True).alias("read")))
    held = lambda read: F.collect_set(F.when(F.col("read") == read, F.col("fact_no")))
    return rows.groupBy("idx").agg(held(False).alias("mentioned"), held(True).alias("read"))


def company_hits_of(results: DataFrame, facts: DataFrame, numbers: list[int]) -> DataFrame:
    """What company_hits() gives for the facts ``numbers`` that all questions share, from chunk_facts(): no text is joined to results.

    ``results`` has ``id``, ``code``, ``place``, ``idx``.
    """
    has = lambda c, n: F.coalesce(F.array_contains(c, n), F.lit(False))
    hits = {n: has("mentioned", n) | ((F.col("place") == 1) & has("read", n)) for n in numbers}
    each = results.select("id", "code", "place", "idx").join(facts, "idx", "left").groupBy("id", "code").agg(*(F.max(hit).alias(f"hit_{n}") for n, hit in hits.items()))
    total = each.groupBy("id").agg(F.count("*").alias("companies_total"), *(F.count_if(f"hit_{n}").alias(f"hit_{n}") for n in numbers))
    long = F.explode(F.array(*(F.struct(F.lit(n).alias("fact_no"), F.col(f"hit_{n}").alias("companies_hit")) for n in numbers))).alias("f")
    return total.select("id", long, "companies_total").select("id", "f.fact_no", "f.companies_hit", "companies_total").withColumn("recalled", F.col("companies_hit") == F.col("companies_total"))


def first_names(chunks: DataFrame) -> DataFrame:
    """``code``, ``name``: each company's name as first seen, in the order of idx."""
    return chunks.where("code is not null and idx is not null").groupBy("code").agg(F.min_by("name", F.struct("idx", "name")).alias("name"))


def site_stats(chunks: DataFrame, pages: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: chunks, tables, characters, pages and the terms of the index's vocabulary."""
    own = chunks.where("idx is not null").select("idx", "type", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).distinct()
    known, read = terms.count(), pages.where("key is not null and page is not null").select("key", "page").distinct().count()
    return own.agg(F.count("*").alias("chunks"), F.count_if(F.col("type") == "table").alias("tables"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chars"), F.lit(read).cast("long").alias("pages"), F.lit(known).cast("long").alias("terms"))


def rate(part: Column, whole: Column) -> Column:
    """A share with three decimals; null over nothing."""
    return F.when(whole > 0, F.round(part / whole, 3))


def recall_summary(recalls: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: questions, those answered, recalled and their rate. Every different question counts, answered or not."""
    asked = questions.where("id is not null").select(F.col("id").alias("qid")).distinct().join(recalls, "qid", "left")
    return asked.agg(F.count("*").alias("questions"), F.count("verdict").alias("answered"), F.coalesce(F.sum(F.col("recalled").cast("long")), F.lit(0)).alias("recalled")).withColumn("rate", rate(F.col("recalled"), F.col("questions")))


def verdict_class(verdict: Column) -> Column:
    """``ok``, ``part`` or ``bad`` by how the verdict's text begins; bad by default."""
    return F.when(F.startswith(verdict, F.lit("正确")) | F.startswith(verdict, F.lit("ok")), "ok").when(F.startswith(verdict, F.lit("部分")) | F.startswith(verdict, F.lit("part")), "part").otherwise("bad")


def with_annotations(results: DataFrame, annotations: DataFrame, key: str = "id") -> DataFrame:
    """Results with the people's ``verdict``, ``expected`` and ``analysis`` of the same key and the verdict's ``class``; bad where there is none."""
    own = annotations.select(key, "verdict", "expected", "analysis").dropDuplicates([key])
    joined = results.drop("verdict", "expected", "analysis").join(own, key, "left")
    return joined.withColumn("class", verdict_class(F.coalesce("verdict", F.lit(""))))


def differing(left: DataFrame, right: DataFrame, key: str, values: list[str], tolerance: float = 1.0) -> DataFrame:
    """Keys whose values differ between two results by more than ``tolerance``, or that only one of them has: ``key``, ``column``."""
    a = left.select(key, F.lit(True).alias("__a"), *(F.col(v).alias(f"__a_{v}") for v in values))
    b = right.select(key, F.lit(True).alias("__b"), *(F.col(v).alias(f"__b_{v}") for v in values))
    both = a.join(b, key, "full_outer")
    absent = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.lit("*"))
    off = [F.when(F.col(f"__a_{v}").isNull() != F.col(f"__b_{v}").isNull(), v).when(F.abs(F.col(f"__a_{v}") - F.col(f"__b_{v}")) > tolerance, v) for v in values]
    names = F.when(absent.isNotNull(), F.array(absent)).otherwise(F.array_compact(F.array(*off)))
    return both.select(key, F.explode(names).alias("column"))


def verdict_summary(recalls: DataFrame, questions: DataFrame) -> DataFrame:
    """``verdict``, ``n``: questions by verdict; unanswered ones are bad."""
    asked = questions.where("id is not null").select(F.col("id").alias("qid")).distinct().join(recalls, "qid", "left")
    return asked.groupBy(verdict_class(F.col("verdict")).alias("verdict")).agg(F.count("*").alias("n"))


def coverage(results: DataFrame, companies: DataFrame) -> DataFrame:
    """``qid``, ``hit`` companies among its results, ``total`` companies and the share of it."""
    total = companies.where("code is not null").select("code").distinct().count()
    hit = results.where("code is not null").groupBy("qid").agg(F.count_distinct("code").alias("hit"))
    return hit.select("qid", "hit", F.lit(total).cast("long").alias("total"), rate(F.col("hit"), F.lit(total)).alias("coverage"))


def missing_companies(results: DataFrame, companies: DataFrame, block: int = 1000) -> DataFrame:
    """``qid``, ``code`` of companies that have no result for a question.

    Companies are kept as blocks of about ``block`` codes. Each question meets each block once, and of a block only the
    codes that the question has no result of come out; neither side is gathered anywhere.
    """
    codes = companies.where("code is not null").select("code").distinct()
    blocks = max(1, -(-codes.count() // block))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).alias("block")
    listed = cut_lineage(codes.groupBy(of("code")).agg(F.collect_list("code").alias("codes")))
    named = results.where("qid is not null").groupBy("qid", of(F.coalesce("code", F.lit("")))).agg(F.collect_set("code").alias("named"))
    asked = results.where("qid is not null").select("qid").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    both = asked.join(broadcast_if_small(listed, blocks * block), "block").join(named, ["qid", "block"], "left")
    return both.select("qid", F.explode(F.array_except("codes", F.coalesce("named", F.array().cast("array<string>")))).alias("code"))


def latest_reports(reports: DataFrame) -> DataFrame:
    """The upsert of report metadata by key: of each key's fetches the last one, whole."""
    columns = [c for c in reports.columns if c not in ("key", "fetched_at")]
    last = F.max(F.struct("fetched_at", *columns)).alias("x")
    return reports.where("key is not null").groupBy("key").agg(last).select("key", *(f"x.{c}" for c in columns), "x.fetched_at")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, those of ``new`` in place of those of ``old``; both have the same columns and one row per key."""
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(new)


def picked_reports(reports: DataFrame, keep_annual: int = 2, keep_semi: int = 1) -> DataFrame:
    """``code``, ``kind``, ``tag``, ``place``, ``title``: the newest full reports of each company and kind.

    Titles of summaries, translations and the like don't count, nor do titles without a year; of several
    announcements for one period the newest counts.
    """
    year = F.regexp_extract("title", r"(20\d{2})\s*年(?:年度|半年度)?报告", 1)
    half = F.col("title").contains("半年度报告")
    rows = reports.where("code is not null").select("code", "title", "announcement_date", year.alias("year"), F.when(half, "semi").otherwise("annual").alias("kind")).where(~F.col("title").rlike(NOT_A_REPORT) & (F.col("year") != ""))
    tag = F.concat("year", F.when(F.col("kind") == "semi", "H1").otherwise("A"))
    newest = rows.groupBy("code", "kind", tag.alias("tag")).agg(F.max(F.struct("announcement_date", "title")).alias("x")).select("code", "kind", "tag", "x.announcement_date", "x.title")
    place = F.row_number().over(W.partitionBy("code", "kind").orderBy(F.desc_nulls_last("announcement_date"), F.desc("tag")))
    keep = F.when(F.col("kind") == "semi", keep_semi).otherwise(keep_annual)
    return newest.withColumn("place", place).where(F.col("place") <= keep).select("code", "kind", "tag", "place", "title")


def full_url(url: Column, host: str = "http://static.example") -> Column:
    """An attachment address, relative or absolute, on the static host."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z]*:?//", ""), r"^[^/]*\.[^/]*/", "")
    return F.concat(F.lit(host + "/"), F.regexp_replace(path, "^/+", ""))


def file_digest(content: Column) -> Column:
    """The first 16 hexadecimal digits of the content's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def announcement_date(millis: Column) -> Column:
    """A time in milliseconds since 1970 as a date in the session's time zone."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd")


# Display names of exchanges and kinds of report.
EXCHANGES = {"szse": "深圳证券交易所", "sse": "上海证券交易所", "bse": "北京证券交易所"}
KINDS = {"annual": "年度报告", "semi": "半年度报告"}


def labelled(code: Column, names: dict[str, str]) -> Column:
    """A code's display name; an unknown code is its own name."""
    name = code
    for k, v in names.items():
        name = F.when(code == k, v).otherwise(name)
    return name


def manifest(reports: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per report: ``key``, ``name``, ``exchange``, ``kind``, ``chunks``, ``tables``, ``chars``, ``pages``; absent parts count 0."""
    # Texts differ by their length and a 128-bit hash: none is shuffled.
    different = chunks.where("idx is not null").select("idx", "code", "period", "type", F.char_length("text").alias("n"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2")).distinct()
    own = different.groupBy(F.concat_ws("_", "code", "period").alias("key")).agg(F.count("*").alias("chunks"), F.sum((F.col("type") == "table").cast("long")).alias("tables"), F.sum(F.coalesce("n", F.lit(0)).cast("long")).alias("chars"))
    counted = pages.where("key is not null and page is not null").groupBy("key").agg(F.count_distinct("page").alias("pages"))
    rows = latest_reports(reports).join(own, "key", "left").join(counted, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("key", "name", labelled(F.col("exchange"), EXCHANGES).alias("exchange"), labelled(F.col("kind"), KINDS).alias("kind"), *(zero(c) for c in ("chunks", "tables", "chars", "pages")))


def manifest_totals(rows: DataFrame) -> DataFrame:
    """One row: different companies by name, reports, chunks, tables, characters, pages."""
    return rows.agg(F.count_distinct("name").alias("companies"), F.count("*").alias("reports"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks", "tables", "chars", "pages")))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, mean characters (one decimal), tables."""
    own = chunks.where("idx is not null").select("idx", "type", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).distinct()
    return own.agg(F.count("*").alias("chunks"), F.round(F.sum("n") / F.greatest(F.count("*"), F.lit(1)), 1).alias("mean_chars"), F.count_if(F.col("type") == "table").alias("tables"))
