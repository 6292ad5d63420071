import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import answers, cleaning, layout, tables
from tests.conftest import rows

MAIN = """单位：万元
主要会计数据
| 主要会计数据 | 2024年 | 上年同期 | 增减 |
| --- | --- | --- | --- |
| 营业收入 | 10,472,224. | 78 | 9,000,000.00 | 12.5% |
| 营业收入成本 | 5,000 | 4,000 | 1% |
| 归属于上市公司股东 | 3,000.00 | 2,000.00 |  |
| 的净利润（元） |  |  |  |
| 归属于上市公司股东的扣除非经常性损益的净利润 | 9,999 | 9,999 | 3% |

| 分季度 | 第一季度 | 第二季度 |
| 营业收入 | 99,999,999 | 88,888,888 |"""


def metric(spark, text, name):
    df = spark.createDataFrame([(1, text)], "idx bigint, text string")
    found = tables.extract_metric(df, "idx", "text", name).collect()
    return tuple(found[0])[1:] if found else None


def test_metric_with_split_number_and_unit(spark):
    assert metric(spark, MAIN, "revenue") == pytest.approx((104_722_247_800.0, 90_000_000_000.0, 12.5))


def test_metric_with_label_over_two_rows(spark):
    now, prev, pct = metric(spark, MAIN, "profit")
    assert (now, prev, pct) == (30_000_000.0, 20_000_000.0, None)


@pytest.mark.parametrize("text", [None, "", "没有表", "| a | b |\n| --- | --- |\n| 营业收入 | 5 | 6 |", "| 营业收入 | , | , |"])
def test_no_metric(spark, text):
    assert metric(spark, text, "revenue") is None


def test_merge_split(spark):
    cases = [(["1,2.", "34", "5"], ["1,2.34", "5"]), (["1.", "2.", "3"], ["1.", "2.3"]), (["1.", "22", "33"], ["1.22", "33"]), (["a.", "1"], ["a.", "1"]), (["1.", "123"], ["1.", "123"]), ([], []), ([""], [""])]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c array<string>").select("i", tables.merge_split(F.col("c")).alias("m")).collect()
    assert {r["i"]: r["m"] for r in got} == {i: e for i, (_, e) in enumerate(cases)}


def test_numbers_and_rates(spark):
    df = spark.createDataFrame([("1,234.5",), ("-3%",), (",",), ("x",), (" 1 2 ",), (None,)], "c string")
    assert [r[0] for r in df.select(tables.to_number(F.col("c"))).collect()] == [1234.5, -3.0, None, None, 12.0, None]
    rates = spark.createDataFrame([(3.0, 2.0, None), (3.0, 0.0, None), (3.0, None, None), (3.0, 2.0, 7.0)], "a double, b double, c double")
    assert [r[0] for r in rates.select(tables.yoy(F.col("a"), F.col("b"), F.col("c"))).collect()] == [50.0, None, None, 7.0]
    assert [r[0] for r in spark.createDataFrame([(123456789012.0,), (None,)], "v double").select(tables.format_yi(F.col("v"))).collect()] == ["1,234.57 亿元", "—"]


def test_table_to_markdown(spark):
    cases = [[["", None], ["a ", "b\nc"], ["1"]], [["", ""], ["x"]], [["h"], [None]], []]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "r array<array<string>>").select(tables.to_markdown(F.col("r"))).collect()]
    assert got == ["| a | b c |\n| --- | --- |\n| 1 |  |", None, None, None]


def test_html_and_readable_rows(spark):
    df = spark.createDataFrame([("前\n| 项目 | 本期<1> | 上期 |\n| --- | --- | --- |\n| 收入 |  | 3 |\n后",), ("| one |",)], "t string")
    html = [r[0] for r in df.select(answers.table_html(F.col("t"))).collect()]
    assert html == ['<table class="md-table"><thead><tr><th>项目</th><th>本期&lt;1&gt;</th><th>上期</th></tr></thead><tbody><tr><td>收入</td><td></td><td>3</td></tr></tbody></table>', None]
    assert df.select(answers.row_text(F.col("t"), F.lit("| 收入 |  | 3 |"))).first()[0] == "收入；上期：3"
    assert df.select(answers.row_text(F.col("t"), F.lit("后"))).first()[0] == "后"


def test_highlight(spark):
    df = spark.createDataFrame([("白酒收入<5",)], "t string").select(answers.highlighted(F.col("t"), F.array(F.lit("白"), F.lit("收入"), F.lit("白酒收入"))))
    assert df.first()[0] == "<mark>白酒<mark>收入</mark></mark>&lt;5"


def test_extractive_answers(spark):
    text = "公司概况\n净利润增长\n扣除非 经常性损益的净利润增长明显\n| 项目 | 本期 |\n| --- | --- |\n| 净利润 | 9 |"
    results = spark.createDataFrame([("q", "净利润增长多少", 1, 7, text, "text"), ("q", "净利润增长多少", 2, 8, "无关\n文字", "text"), ("q", "净利润增长多少", 3, 9, "| 甲 |\n| 乙 |", "table"), ("q", "净利润增长多少", 4, 10, text, "text")], "qid string, question string, rank int, idx bigint, text string, type string")
    got = {r["citation"]: r["answer"] for r in answers.extractive_answers(results).collect()}
    assert got[1].startswith("净利润增长；") and got[2] == "无关" and set(got) == {1, 2, 3}


PAGES = [("k", 1, "页眉\n第三节\n\n经营情况\n" + "正文甲。" * 60 + "\n1 / 9", 1), ("k", 2, "页眉\n[表格开始]\n| a | b |\n| --- | --- |\n| 1 | 2 |\n[表格结束]\n收入情况说明\n[表格开始]\n| c |\n[表格结束]", 1), ("k", 3, "页眉\n第四节 其他\n一、小节\n" + "尾" * 130, 1), ("k", 3, "旧", 0), ("k", 4, None, 1), (None, 5, "x", 1)]


@pytest.fixture(scope="module")
def pages(spark):
    return cleaning.latest_pages(spark.createDataFrame(PAGES, "key string, page int, text string, extracted_at int"))


def test_page_cleaning(pages):
    assert rows(cleaning.boilerplate(pages).select("line", "on_pages")) == [("页眉", 3)]
    assert rows(cleaning.page_numbers(pages).select("page", "line")) == [(1, "1 / 9")]
    assert rows(cleaning.sections(pages).select("page", "title")) == [(1, "第三节 经营情况"), (3, "第四节 其他")]
    kinds = rows(cleaning.segments(pages).where("kind = 'table'").select("page", "content"))
    assert kinds == [(2, "| a | b |\n| --- | --- |\n| 1 | 2 |"), (2, "| c |")]
    assert rows(cleaning.captions(pages).select("page", "caption")) == [(2, "收入情况说明"), (2, "经营情况")]
    carried = {r["section"] for r in cleaning.carried_sections(pages).where("page = 3").collect()}
    assert carried == {"第三节", "第四节 其他"}


def test_chunks_of_pages(pages):
    made = sorted((r.asDict() for r in cleaning.chunk_reports(pages).collect()), key=lambda r: r["id"])
    assert [(c["type"], c["section"], c["page_start"]) for c in made] == [("text", "第三节 经营情况", 1), ("table", "第三节 经营情况", 2), ("table", "第三节 经营情况", 2), ("text", "第四节 其他", 3)]
    assert made[0]["text"] == "正文甲。" * 60 and made[2]["text"] == "收入情况说明\n| c |" and made[2]["table_caption"] == "收入情况说明"
    assert made[3]["subsection"] == "一、小节" and made[1]["table_rows"] == 3 and all(c["n_chars"] == len(c["text"]) for c in made)


@pytest.mark.parametrize(("size", "chunks"), [(199, [[0, 1]]), (200, [[0], [1]]), (219, [[0], [1]]), (220, [[0], [1]])])
def test_text_before_a_table(size, chunks):
    assert held(["line", "table"], [size, 5]) == chunks


def held(kinds, sizes):
    """The events of each chunk."""
    out = {}
    for number, _, k in cleaning.packed(kinds, sizes):
        out.setdefault(number, []).append(k)
    return [out[n] for n in sorted(out)]


def test_overflow_keeps_a_short_last_line():
    assert held(["line", "line", "line", "end"], [900, 250, 100, 0]) == [[0, 1], [1, 2]]
    assert held(["line", "line", "line", "end"], [900, 300, 120, 0]) == [[0, 1], [2]]
    assert held(["line", "end"], [119, 0]) == [] and held([], []) == []


def test_headings_and_blank_lines_end_chunks():
    assert held(["line", "section", "line", "end"], [219, 4, 120, 0]) == [[2]]
    assert held(["line", "section", "line", "end"], [220, 4, 120, 0]) == [[0], [2]]
    assert held(["line", "sub", "line", "end"], [219, 4, 1, 0]) == [[0, 2]]
    assert held(["line", "sub", "line", "end"], [220, 4, 120, 0]) == [[0], [2]]
    assert held(["line", "blank", "line", "end"], [699, 0, 120, 0]) == [[0, 2]]
    assert held(["line", "blank", "line", "end"], [700, 0, 120, 0]) == [[0], [2]]
    assert [at for _, at, _ in cleaning.packed(["line", "sub", "end"], [220, 4, 0])] == [1]


def test_labels_of_chunks(spark):
    """A text kept past a subsection heading has its label; of headings alone on their lines every second one is taken in; captions don't reach across sections."""
    text = "\n".join(["第一节", "第二节", "第三节", "", "一、甲", "短文" * 50, "二、乙", "长文" * 60, "[表格开始]", "| a |", "[表格结束]", "第四节 丁", "[表格开始]", "| b |", "[表格结束]"])
    made = sorted((r.asDict() for r in cleaning.chunk_reports(spark.createDataFrame([("k", 1, text), *(("k", p, "") for p in (2, 3, 4))], "key string, page int, text string")).collect()), key=lambda r: r["id"])
    assert [(c["id"], c["section"], c["subsection"], c["type"], c["table_caption"]) for c in made] == [("k#0001", "第三节 一、甲", "二、乙", "text", None), ("k#0002", "第三节 一、甲", "二、乙", "table", "二、乙"), ("k#0003", "第四节 丁", "", "table", "第四节 丁")]
    assert made[0]["text"] == "短文" * 50 + "\n" + "长文" * 60


def test_layout(spark):
    blocks = spark.createDataFrame([("k", 1, 0.0, 0.0, 10.0, 10.0, "text", "in", 0), ("k", 1, 50.0, 50.0, 60.0, 60.0, "text", "out", 1), ("k", 1, 50.0, 5.0, 60.0, 6.0, "text", "top", 2), ("k", 1, 1.0, 1.0, 2.0, 2.0, "image", "pic", 3), ("k", 1, 70.0, 70.0, 71.0, 71.0, "text", "　 ", 4)], "key string, page int, x0 double, y0 double, x1 double, y1 double, kind string, text string, seq int")
    boxes = spark.createDataFrame([("k", 1, 0.0, 0.0, 4.0, 4.0)], "key string, page int, x0 double, y0 double, x1 double, y1 double")
    assert rows(layout.page_text(layout.outside_tables(layout.text_blocks(blocks), boxes))) == [("k", 1, "top\nout")]
