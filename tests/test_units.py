import pytest

from ledgerlens.operators.units import figures
from tests.conftest import rows

CASES = [
    ("公司当期营业收入合计159,306千元，同比增长21.40%。", "revenue", 159_306_000),
    ("本期合同负债从去年同期129,483千元变动至1.5亿元。", "contract_liab", 150_000_000),
    ("报告期内，公司的合同负债由上年同期的1,551,208,720.40元变为７，３１９．５９万元。", "contract_liab", 73_195_900),
    ("归母净利润达六亿六千四百万元，同比下降33.86%（上年同期为0.13亿元）。", "net_profit", 664_000_000),
    ("本期归母净利润-7,891.41 万元", "net_profit", -78_914_100),
    ("营收 18亿3544万元。", "revenue", 1_835_440_000),
    ("营收为二百亿七千八百万元", "revenue", 20_078_000_000),
    ("合同负债余额为一亿零一百万元", "contract_liab", 101_000_000),
    ("本期成品酒产量为八十一万升", "output", 810_000),
    ("成品酒入库量达26589.6立方米", "output", 26_589_600),
    ("成品酒入库量9.5kL", "output", 9_500),
    ("原粮采购量合计11724吨523公斤。", "grain", 11_724_523),
    ("期内公司原粮采购量0.843万吨。", "grain", 8_430_000),
    ("（单位：千元）合同负债余额 27003", "contract_liab", 27_003_000),
    ("以下金额单位均为亿元：营收：18.27；", "revenue", 1_827_000_000),
    ("Net profit attributable to shareholders of RMB 0.485 billion was recorded for the period.", "net_profit", 485_000_000),
    ("Finished liquor output came to 23,549.4 kilolitres in the period.", "output", 23_549_400),
    ("Grain purchases came to 172,322.0 tonnes in the period.", "grain", 172_322_000),
    ("单位：百万元\n| 项目 | 本期 | 上期 | 增减（%） |\n| --- | --- | --- | --- |\n| 归母净利润 | (36.5) | 25.2 |  |", "net_profit", -36_500_000),
    ("| 科目 | 上期（万元） | 本年（万元） |\n| --- | --- | --- |\n| 营收 | 1.00 | 2.50 |", "revenue", 25_000),
    ("| 指标 | 本报告期 | 上期 |\n| --- | --- | --- |\n| 营业收入（亿元） | 3.00 | 2.50 |", "revenue", 300_000_000),
    ("| 指标 | 本报告期 | 上期 |\n| --- | --- | --- |\n| 营业收入 | 16,562千元 | 787,699千元 |", "revenue", 16_562_000),
]


@pytest.fixture(scope="module")
def table(spark):
    texts = [(i, t, "other") for i, (t, _, _) in enumerate(CASES)]
    extra = [(900, None, "x"), (901, "", "x"), (None, "营收 5元", "x"), (902, "营收同比增长5%", "x"), (903, "| 项目 | 本期 | 上期 |\n| 营收 | 不适用 | 5 |", "x"), (904, "营收 3吨", "x"), (0, CASES[0][0], "again"), (905, "文" * 200_000 + "营收 5元", "x"), (906, "营收 5元。营收 6元。", "x")]
    return spark.createDataFrame(texts + extra, "idx bigint, text string, measure string")


def test_figures_in_many_notations(table):
    found = {(r[0], r[1]): r[2] for r in rows(figures(table))}
    assert {k: v for k, v in found.items() if k[0] < 900} == {(i, m): v for i, (_, m, v) in enumerate(CASES)}


def test_rows_without_a_current_figure(table):
    found = {r[0]: r[2] for r in rows(figures(table)) if r[0] >= 900}
    assert found == {905: 5, 906: 5}


def test_the_first_figure_in_the_text_holds(spark):
    row = lambda n, v: f"| {n} | {v} | 1 |"
    head = "| 项目 | 本期 | 上期 |\n| --- | --- | --- |\n"
    cases = [
        (head + row("合同负债", "1元") + "\n" + row("营业收入", "5元") + "\n此后营业收入7元", 5),
        (head + row("营业收入", "5元") + "\n此后营业收入7元", 5),
        ("先是营业收入7元\n" + head + row("营业收入", "5元"), 7),
        ("合同负债1元，营业收入7元\n" + head + row("营业收入", "5元"), 7),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)] + [(9, "营收 6元"), (9, "营收 5元")], "idx bigint, text string")
    assert {r["idx"]: r["value"] for r in figures(df).where("measure = 'revenue'").collect()} == {**{i: v for i, (_, v) in enumerate(cases)}, 9: 5}


def test_empty_table(spark):
    assert rows(figures(spark.createDataFrame([], "idx bigint, text string"))) == []
