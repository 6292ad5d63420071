"""Fixed values of question understanding: phrases, expansions and names that results depend on."""

from __future__ import annotations

# Phrases in questions and the wording of reports that is added to the query, in the order in which they are added.
EXPANSIONS = [
    ("归母净利润", "归属于上市公司股东的净利润"),
    ("归母净利", "归属于上市公司股东的净利润"),
    ("归母", "归属于上市公司股东的净利润"),
    ("净利润", "归属于上市公司股东的净利润 利润总额"),
    ("营收", "营业收入"),
    ("营业总收入", "营业收入"),
    ("同比", "比上年同期增减"),
    ("增长率", "比上年同期增减"),
    ("分红", "利润分配 派发现金红利 每10股"),
    ("毛利率", "毛利率 分产品 营业成本"),
    ("费用率", "销售费用 管理费用 占营业收入比重"),
    ("现金流", "经营活动产生的现金流量净额"),
    ("库存", "存货 存货跌价准备"),
    ("存货", "存货 存货跌价准备"),
    ("应收账款", "应收账款 坏账准备"),
    ("合同负债", "合同负债 预收款项"),
    ("经销商", "经销商 经销商数量 增加减少"),
    ("产能", "产能 产量 销量 库存量"),
    ("省外", "省外 其他地区 分地区"),
    ("省内", "省内 山西省内 分地区"),
    ("分红率", "现金分红 占合并报表中归属于上市公司普通股股东的净利润的比率"),
    ("存货周转", "存货周转率 存货周转天数"),
    ("毛利率下滑", "毛利率比上年同期增减"),
    ("高管薪酬", "董事、监事和高级管理人员报酬"),
    ("研发", "研发投入 研发人员"),
    ("风险", "可能面对的风险 风险因素"),
    ("经营计划", "公司未来发展的展望 经营计划"),
]

# Short names of companies, in the order in which they are tried.
ALIASES = [
    ("茅台", "600519"),
    ("洋河", "002304"),
    ("汾酒", "600809"),
    ("老窖", "000568"),
    ("古井", "000596"),
    ("迎驾", "603198"),
    ("口子", "603589"),
    ("舍得", "600702"),
    ("水井坊", "600779"),
    ("金徽", "603919"),
    ("酒鬼", "000799"),
    ("天佑德", "002646"),
    ("金种子", "600199"),
    ("今世缘", "603369"),
    ("老白干", "600559"),
    ("五粮液", "000858"),
]

# Wordings that stand for one metric in a question over all companies, first match first.
METRIC_QUERIES = [
    (("营业收入", "营收"), "主要会计数据 营业收入 上年同期 增减"),
    (("净利润",), "主要会计数据 归属于上市公司股东的净利润 上年同期 增减"),
    (("毛利率",), "主营业务 分产品 毛利率 比上年同期增减"),
]

# Words that make a question one about half-year reports.
HALF_YEAR = ("半年", "中报", "上半年")

# Fixed value: titles of announcements that are not the full report itself.
NOT_A_REPORT = "摘要|英文|英文版|意见|说明|专项|补充|更正|公告|H股|港股|海外"

# Header words that a readable table row leaves out.
HEADER_NOISE = ("主要会计数据", "项目", "科目", "主要财务指标")

# BM25 parameters, least document frequency, fusion weight of the dense channel.
K1, B, MIN_DF, ALPHA = 1.5, 0.75, 2, 0.5

# Chunk sizes in characters, share of pages that makes a short line boilerplate, and its length limit.
TARGET, LEAST, MOST, PAGE_SHARE, SHORT_LINE = 700, 220, 1100, 0.3, 40
