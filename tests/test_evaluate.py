import random

from pyspark.sql import functions as F

from ledgerlens.operators import evaluate, index, layout, tables
from ledgerlens.operators.contain import contained
from ledgerlens.plans import catalogue
from ledgerlens.sources import readers, sinks
from ledgerlens.streaming import incremental
from tests.conftest import rows


def test_containment_ignores_whitespace(spark):
    items = spark.createDataFrame([(1, "甲 乙"), (2, ""), (3, None), (4, "丁")], "item_id bigint, expected string")
    docs = spark.createDataFrame([(10, "x甲\n乙y"), (11, None), (12, "甲丙乙"), (10, "x甲\n乙y")], "doc_id bigint, text string")
    assert rows(contained(items, docs, "item_id", "expected", "doc_id", "text")) == [(1, 10)]
    assert rows(contained(items, docs, "item_id", "expected", "doc_id", "text", squeezed=False)) == []
    assert rows(contained(items.where("false"), docs, "item_id", "expected", "doc_id", "text")) == []


def test_containment_of_phrases_of_every_length(spark):
    rng = random.Random(9)
    texts = [(t, "".join(rng.choice("甲乙丙") for _ in range(rng.randint(0, 90)))) for t in range(60)]
    phrases = [(k % 30, "".join(rng.choice("甲乙丙") for _ in range(1 + k % 23))) for k in range(60)] + [(50 + k, texts[k][1][k % 7 :]) for k in range(20)]
    got = {tuple(r) for r in contained(spark.createDataFrame(phrases, "k int, p string"), spark.createDataFrame(texts, "t int, x string"), "k", "p", "t", "x").collect()}
    assert got == {(k, t) for k, p in phrases for t, x in texts if p and p in x}


def test_companies_without_results(spark):
    results = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", None), ("b", "3"), ("c", None), (None, "1")], "qid string, code string")
    companies = spark.createDataFrame([(str(k), "x") for k in range(1, 6)] * 2 + [(None, "x")], "code string, name string")
    for block in (1000, 2):
        assert rows(evaluate.missing_companies(results, companies, block)) == sorted([(q, str(k)) for q, have in (("a", {1, 2}), ("b", {3}), ("c", set())) for k in range(1, 6) if k not in have], key=repr)


def test_facts_ranks_and_coverage(spark):
    """A fact is recalled in scope only, covered by what an answer uses, and may be split between the texts that it uses."""
    questions = spark.createDataFrame([("a", "营收和分红", "1", "2024", 0), ("b", "库存", None, None, 0), ("c", "天气", None, None, 0), ("d", "营收", None, None, 0)], "id string, question string, code string, period string, extra int")
    results = spark.createDataFrame([("a", 1, 1, "2", "2024A", "营业 收入"), ("a", 2, 2, "1", "2024A", "利润分"), ("a", 3, 3, "1", "2024A", "配"), ("a", 4, 4, "1", "2024H1", "营\n收"), ("b", 1, 5, "9", None, None)], "id string, rank int, idx bigint, code string, period string, text string")
    facts = evaluate.question_facts(questions)
    assert {r["pattern"] for r in facts.where("id = 'a' and fact_no = 5").collect()} == {"营收", "营业收入"}
    hits = evaluate.fact_hits(results, facts, questions)
    got = {(r["id"], r["fact_no"]): (r["hit_rank"], r["covered"]) for r in hits.collect()}
    assert got == {("a", 5): (4, True), ("a", 9): (None, True), ("b", 13): (None, False), ("d", 5): (None, False)}
    assert rows(evaluate.gold_results(results, facts, questions).select("id", "rank", "gold")) == [("a", 1, False), ("a", 2, False), ("a", 3, False), ("a", 4, True), ("b", 1, False)]
    notes = spark.createDataFrame([("a", "正确", "e", "x")], "id string, verdict string, expected string, analysis string")
    built = evaluate.evaluation(hits, notes)
    assert rows(built.select("id", "recall_hits", "facts", "recall_rate", "coverage_hits", "gold_rank", "gold_recalled", "class")) == [("a", 1, 2, 0.5, 2, 4, False, "ok"), ("b", 0, 1, 0.0, 0, None, False, "bad"), ("d", 0, 1, 0.0, 0, None, False, "bad")]
    assert evaluate.evaluation_summary(built).select("questions", "recall_hits", "facts", "recall_rate", "correct", "wrong").first()[:] == (3, 1, 4, 0.25, 1, 2)
    assert evaluate.evaluation_summary(built.where("false")).select("questions", "facts", "recall_rate").first()[:] == (0, 0, None)


def test_recall_and_verdicts(spark):
    ranked = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 9, True), ("c", 1, False)], "qid string, rank int, gold boolean")
    recalls = evaluate.recall_at(ranked, 8)
    assert rows(recalls) == [("a", 1, True, "ok"), ("b", 9, False, "part"), ("c", None, False, "bad")]
    questions = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",), (None,)], "id string")
    assert tuple(evaluate.recall_summary(recalls, questions).first()) == (4, 3, 1, 0.25)
    assert rows(evaluate.verdict_summary(recalls, questions)) == [("bad", 2), ("ok", 1), ("part", 1)]


def test_gold_beyond_any_head_is_part(spark, tmp_path):
    results = [(q, i, float(1000 - i), 0.0, i == gold, "1") for q, gold in (("a", 59), ("b", 3), ("c", None), ("d", 1499)) for i in range(1500 if q == "d" else 60)]
    spark.createDataFrame(results, "qid string, idx bigint, bm25 double, cos double, gold boolean, code string").write.parquet(f"{tmp_path}/retrieved.parquet")
    spark.createDataFrame([(q,) for q in "abcde"], "id string").write.parquet(f"{tmp_path}/questions.parquet")
    queries = catalogue.queries()
    assert rows(queries["recall_at_k"](spark, str(tmp_path))) == [("a", 60, False, "part"), ("b", 4, True, "ok"), ("c", None, False, "bad"), ("d", 1500, False, "part")]
    assert rows(queries["verdict_summary"](spark, str(tmp_path))) == [("bad", 2), ("ok", 1), ("part", 2)]


def test_every_shown_result_is_marked(spark, tmp_path):
    spark.createDataFrame([("q", i, float(1000 - i), 0.0, False, "1") for i in range(10)], "qid string, idx bigint, bm25 double, cos double, gold boolean, code string").write.parquet(f"{tmp_path}/retrieved.parquet")
    spark.createDataFrame([("q", "营收")], "id string, question string").write.parquet(f"{tmp_path}/questions.parquet")
    chunks = spark.createDataFrame([(i, f"{i} 营收") for i in range(10)], "idx bigint, text string")
    chunks.selectExpr("idx", "text", "'' name", "'' title", "'' section", "'' subsection", "1 page_start", "1 page_end", "'text' type").write.parquet(f"{tmp_path}/chunks.parquet")
    assert rows(catalogue.queries()["highlight"](spark, str(tmp_path))) == [("q", i, f"{i} <mark>营收</mark>") for i in range(8)]


def test_published_totals_follow_from_their_questions(spark):
    # The published per-question hits and totals of the reference evaluation.
    recall = spark.createDataFrame([(3,), (1,), (2,), (2,), (1,), (1,), (1,), (1,), (1,), (1,), (0,)], "hit int").agg(F.sum("hit").alias("hit"), F.lit(15).alias("total"))
    assert tuple(recall.select("hit", evaluate.rate(F.col("hit"), F.col("total"))).first()) == (14, 0.933)
    assert spark.range(1).select(evaluate.rate(F.lit(57), F.lit(60)), evaluate.rate(F.lit(1), F.lit(0))).first()[:] == (0.95, None)


REPORTS = [("a_2024A", "a", "甲", "szse", "2024A", "annual", "甲2024年年度报告", "2025-03-01", None, 1), ("a_2024A", "a", "甲", "szse", "2024A", "annual", "甲2024年年度报告", "2025-03-02", 9, 2), ("a_2023A", "a", "甲", "szse", "2023A", "annual", "甲2023年年度报告", "2024-03-01", 5, 1), ("a_2022A", "a", "甲", "szse", "2022A", "annual", "甲2022年年度报告", "2023-03-01", 5, 1), ("a_2024H1", "a", "甲", None, "2024H1", "semi", "甲2024年半年度报告", None, 5, 1), ("a_x", "a", "甲", "zzz", "x", "annual", "甲2024年年度报告摘要", "2025-04-01", 5, 1), (None, None, None, None, None, None, None, None, None, 1)]
COLUMNS = "key string, code string, name string, exchange string, period string, kind string, title string, announcement_date string, bytes bigint, fetched_at int"


def test_reports(spark):
    reports = spark.createDataFrame(REPORTS, COLUMNS)
    latest = {r["key"]: r["bytes"] for r in evaluate.latest_reports(reports).collect()}
    assert latest == {"a_2024A": 9, "a_2023A": 5, "a_2022A": 5, "a_2024H1": 5, "a_x": 5}
    assert rows(evaluate.picked_reports(reports).select("tag", "place")) == [("2023A", 2), ("2024A", 1), ("2024H1", 1)]
    chunks = spark.createDataFrame([(1, "a", "2024A", "table", "xy"), (1, "a", "2024A", "table", "xy"), (2, "a", "2024A", "text", None)], "idx bigint, code string, period string, type string, text string")
    pages = spark.createDataFrame([("a_2024A", 1), ("a_2024A", 1), ("a_2024A", 2)], "key string, page int")
    listed = {r["key"]: tuple(r)[2:] for r in evaluate.manifest(reports, chunks, pages).collect()}
    assert listed["a_2024A"] == ("深圳证券交易所", "年度报告", 2, 1, 2, 2) and listed["a_x"] == ("zzz", "年度报告", 0, 0, 0, 0) and listed["a_2024H1"][0] is None
    assert tuple(evaluate.chunk_stats(chunks).first()) == (2, 1.0, 1)
    new = spark.createDataFrame([("k", 2), ("n", 3)], "key string, v int")
    assert rows(evaluate.upsert(spark.createDataFrame([("k", 1), ("o", 1)], "key string, v int"), new, "key")) == [("k", 2), ("n", 3), ("o", 1)]


def test_addresses_and_dates(spark):
    df = spark.createDataFrame([("http://a.example/x/y.pdf",), ("/x/y.pdf",), ("x/y.pdf",)], "u string")
    assert {r[0] for r in df.select(evaluate.full_url(F.col("u"))).collect()} == {"http://static.example/x/y.pdf"}
    assert spark.range(1).select(evaluate.announcement_date(F.lit(86_400_000))).first()[0] == "1970-01-02"


CHUNKS = [(1, "节", "", "白酒白酒 收入"), (5000, None, None, "收入 abc"), (9000, "", "", None)]


def test_index_shards_round_trip(spark):
    tokens = index.tokenized(spark.createDataFrame(CHUNKS, "idx bigint, section string, subsection string, text string"))
    shards = sinks.index_shards(index.encode_gaps(tokens))
    assert rows(sinks.read_shards(shards)) == rows(index.term_freq(tokens))
    assert sinks.get_varint(sinks.put_varint(300), 0) == (300, 2)


def test_files_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "000001", 1, "正文")], "id string, code string, page_start int, text string")
    sinks.write_chunks(chunks, str(tmp_path / "chunks"))
    assert readers.read_chunks(spark, str(tmp_path / "chunks")).select("id", "code", "page_start", "text", "table_rows").first()[:] == ("c1", "000001", 1, "正文", None)
    (tmp_path / "meta.json").write_text('{"a_2024A": {"code": "000001", "bytes": 5}, "b": {"code": "000002"}}')
    assert rows(readers.read_metadata(spark, str(tmp_path / "meta.json")).select("key", "code", "bytes")) == [("a_2024A", "000001", 5), ("b", "000002", None)]
    (tmp_path / "parsed.json").write_text('{"key": "a", "pages": [{"page": 1, "text": "x"}, {"page": 2, "text": null}]}')
    assert rows(readers.pages_of(readers.read_parsed(spark, str(tmp_path / "parsed.json")))) == [("a", 1, "x"), ("a", 2, None)]


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>甲<script>x()</script></p><div>乙 &amp; 丙")
    (tmp_path / "b.txt").write_text("一\f二")
    (tmp_path / "c.bin").write_bytes(b"\0")
    got = rows(readers.scan_files(spark, str(tmp_path)).select("page", "text", F.col("error").isNull()))
    assert got == sorted([(1, "甲\n乙 & 丙", True), (1, "一", True), (2, "二", True), (None, None, False)], key=repr)


def test_scanned_layout_to_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>前言</p><table><tr><th>项目</th><th>本期</th></tr><tr><td>收入 </td><td>5</td></tr></table><p>后<br>记</p><table><tr><td>单行</td></tr></table>")
    (tmp_path / "b.htm").write_text("<p> </p>")
    (tmp_path / "c.pdf").write_bytes(b"none")
    items = readers.scan_layout(spark, str(tmp_path))
    pages = {r["key"][-6:]: r["text"] for r in layout.parsed_pages(items).collect()}
    assert pages == {"a.html": "前言\n\n[表格开始]\n| 项目 | 本期 |\n| --- | --- |\n| 收入 | 5 |\n[表格结束]\n\n后\n记", "/b.htm": ""}
    assert rows(layout.parsed_tables(items).select("index", "rows", "cols")) == [(0, 2, 2)]
    assert items.where("error is not null").count() == 1
    boxed = lambda content: [([(0, 0, 4, 4, "text", "in the table"), (0, 20, 4, 24, "text", " below "), (0, 30, 4, 34, "image", "x")], [(0, 0, 5, 5, [["a", None], ["b", "c"]])])]
    own = readers.scan_layout(spark, str(tmp_path / "c.pdf"), {"pdf": boxed})
    assert [r["text"] for r in layout.parsed_pages(own).collect()] == ["\n[表格开始]\n| a |  |\n| --- | --- |\n| b | c |\n[表格结束]\n\nbelow"]


def test_annotations_and_announcements_of_files(spark, tmp_path):
    (tmp_path / "notes.json").write_text('{"questions": [{"id": "Q1", "verdict": "正确", "more": 1}, {"id": "Q2"}]}')
    assert rows(readers.read_annotations(spark, str(tmp_path / "notes.json")).select("id", "verdict")) == [("Q1", "正确"), ("Q2", None)]
    folder = tmp_path / "pages"
    folder.mkdir()
    for page, more, titles in ((1, "true", ["a", "b"]), (2, "false", ["c"]), (3, "true", ["late"])):
        told = ", ".join(f'{{"secCode": "000001", "announcementTitle": "{t}", "announcementTime": 5}}' for t in titles)
        (folder / f"{page}.json").write_text(f'{{"pageNum": {page}, "hasMore": {more}, "announcements": [{told}]}}')
    assert rows(readers.read_announcements(spark, str(folder)).select("page", "title")) == [(1, "a"), (1, "b"), (2, "c")]


def test_markdown_report(spark):
    report = sinks.markdown_report("T", {"x": spark.createDataFrame([(2, None), (1, "a|b")], "n int, s string")})
    assert report == "# T\n\n## x\n\n| n | s |\n| --- | --- |\n| 1 | a\\|b |\n| 2 | — |\n"
    many = spark.range(1500)
    assert sinks.markdown_report("T", {"x": many}).count("\n| ") == 1502
    assert sinks.markdown_report("T", {"x": many}, most=10).endswith("| 9 |\n\n1490 more rows.\n")
    ranked = sinks.by_revenue(spark.createDataFrame([("a", None), ("b", 5.0), ("c", -1.0)], "code string, revenue double"))
    assert [x.split(" ")[1] for x in sinks.markdown_report("T", {"x": ranked}).splitlines()[6:]] == ["b", "a", "c"]


def test_index_keeps_high_frequencies(spark):
    tokens = index.tokenized(spark.createDataFrame([(1, "", "", "酒 " * 70)], "idx bigint, section string, subsection string, text string"))
    assert rows(sinks.read_shards(sinks.index_shards(index.encode_gaps(tokens)))) == [("酒", 1, 70)]
    assert rows(index.encode_gaps(tokens, tf_cap=64).select("tf")) == [(64,)]


def test_site_and_manifest_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([(3, "乙", "s"), (1, "丙", None), (2, None, "t")], "idx bigint, name string, section string")
    sinks.write_site(chunks, str(tmp_path / "site"), {"name": None, "section": "idx"})
    assert rows(sinks.read_site(spark, str(tmp_path / "site")).select("idx", "name", "section")) == rows(chunks)
    assert spark.read.json(str(tmp_path / "site/meta")).select("chunks", "name_values", "section_values").first()[:] == (3, 2, 2)
    manifest = spark.createDataFrame([("2_2024A", 1), ("1_2024H1", 2), ("1_2024A", 3)], "key string, chunks int")
    sinks.write_manifest(manifest, manifest.groupBy().sum("chunks"), str(tmp_path / "manifest"))
    assert rows(spark.read.json(str(tmp_path / "manifest/reports")).select("key", "chunks")) == [("1_2024A", 3), ("1_2024H1", 2), ("2_2024A", 1)]
    assert [r["key"] for r in sinks.ordered(manifest).collect()] == ["1_2024A", "1_2024H1", "2_2024A"]
    sinks.write_evaluation(spark.createDataFrame([("a", 1)], "id string, n int"), spark.range(1), str(tmp_path / "eval"))
    assert spark.read.json(str(tmp_path / "eval/questions")).first()["n"] == 1


def test_a_chunk_without_terms_replaces_its_earlier_version(spark, tmp_path):
    folder = tmp_path / "in"
    for text in ("酒厂", ""):
        spark.createDataFrame([(1, "", "", text)], "idx bigint, section string, subsection string, text string").coalesce(1).write.mode("append").json(str(folder))
        q = incremental.index_stream(incremental.chunk_stream(spark, str(folder), 1), str(tmp_path / "sink"), str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert rows(incremental.current_counts(spark, str(tmp_path / "sink"))) == []


def test_streamed_index_equals_the_batch_index(spark, tmp_path):
    folder = tmp_path / "in"
    df = spark.createDataFrame(CHUNKS, "idx bigint, section string, subsection string, text string")
    for k in range(2):
        df.where(F.col("idx") % 2 == k).coalesce(1).write.mode("append").json(str(folder))
    q = incremental.index_stream(incremental.chunk_stream(spark, str(folder), 1), str(tmp_path / "sink"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert rows(incremental.current_counts(spark, str(tmp_path / "sink"))) == rows(index.term_counts(index.tokenized(df)))


def test_annotations_and_differences(spark):
    results = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, verdict string")
    notes = spark.createDataFrame([("a", "正确", "e", "n"), ("b", "部分正确", None, None), ("z", "错误", None, None)], "id string, verdict string, expected string, analysis string")
    assert rows(evaluate.with_annotations(results, notes).select("id", "class")) == [("a", "ok"), ("b", "part"), ("c", "bad")]
    left = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", None), ("d", 1.0)], "k string, v double")
    right = spark.createDataFrame([("a", 1.5), ("b", 9.0), ("c", 1.0), ("e", 1.0)], "k string, v double")
    assert rows(evaluate.differing(left, right, "k", ["v"])) == [("b", "v"), ("c", "v"), ("d", "*"), ("e", "*")]


def test_dictionaries_round_trip(spark):
    df = spark.createDataFrame([(3, "乙"), (1, "丙"), (2, None), (4, "丙")], "idx bigint, s string")
    first = index.dictionary(df, "s", "idx")
    assert rows(first) == [("丙", 0), ("乙", 1)] and rows(index.dictionary(df, "s")) == [("丙", 0), ("乙", 1)]
    codes = index.encoded(df, {"s": first})
    assert rows(codes.select("idx", "s")) == [(1, 0), (2, None), (3, 1), (4, 0)]
    assert rows(index.decoded(codes, {"s": first}).select("idx", "s")) == rows(df)
    empty = spark.createDataFrame([], "idx bigint, s string")
    assert rows(index.dictionary(empty, "s")) == []


def test_embedded_text_is_cut(spark):
    df = spark.createDataFrame([("甲", None, "", "节", "文" * 3000), (None, None, None, None, None)], "name string, period string, section string, subsection string, text string")
    assert [r[0] for r in df.select(index.embed_text(df)).collect()] == ["甲 节\n" + "文" * 1496, "\n"]


def test_hits_of_shared_facts_without_texts(spark):
    """Facts that all questions share are found in the chunks, not in results joined to texts."""
    table = "单位：元\n| 主要会计数据 | 本期 | 上年同期 |\n| --- | --- | --- |\n| 营业收入 | 5,000.00 | 4,000.00 |"
    chunks = spark.createDataFrame([(1, "营 业收入增长"), (2, table.replace("营业收入", "营业总收入")), (3, None), (4, "归母净利润"), (1, "营 业收入增长")], "idx bigint, text string")
    results = spark.createDataFrame([("q", "a", 1, 1), ("q", "b", 1, 2), ("q", "c", 1, 3), ("q", "c", 2, 2), ("r", "a", 1, 3), ("r", "a", 2, 4)], "id string, code string, place int, idx bigint")
    patterns = {1: ("营业收入", "营收"), 2: ("归母净利润",)}
    facts = spark.createDataFrame([(i, n, p) for i in "qr" for n, some in patterns.items() for p in some], "id string, fact_no int, pattern string")
    parsed = [tables.extract_metric(chunks.distinct(), "idx", "text", m).select("idx", F.lit(m).alias("metric")) for m in ("revenue", "profit")]
    expected = rows(evaluate.company_hits(results.join(chunks.distinct(), "idx"), facts, parsed[0].unionByName(parsed[1])))
    found = evaluate.company_hits_of(results, evaluate.chunk_facts(chunks, patterns), [1, 2])
    assert rows(found.select("id", "fact_no", "companies_hit", "companies_total", "recalled")) == expected == [("q", 1, 2, 3, False), ("q", 2, 0, 3, False), ("r", 1, 0, 1, False), ("r", 2, 1, 1, True)]
