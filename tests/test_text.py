import json
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions.encoder import embedder
from ledgerlens.functions.text import NARROW, NOT_PLAIN, SPACE, WIDE, fold_width, folded_terms, nfkc, squeeze, terms, terms_of, tidy
from ledgerlens.functions.wordpiece import encode, pieces, words


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "x string").select(expr(F.col("x")).alias("y")).first()[0]


def test_terms_of_han_and_latin_runs(spark):
    assert one(spark, "营收Ａ1.5%", terms) == ["营", "收", "营收", "a1.5%"]
    assert one(spark, "étude X_y", terms) == ["é", "tude", "x", "y"]
    assert one(spark, "①万", terms) == ["1", "万"]
    assert one(spark, "①万", lambda c: terms(c, False)) == ["万"]


def test_terms_in_python_are_those_in_the_jvm(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("营收豈㐀éab1.5%, x。\n") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "豈", "酒" * 3000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", folded_terms(F.col("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: terms_of(t) for i, t in enumerate(texts)}


def test_terms_of_nothing(spark):
    assert one(spark, None, terms) == []
    assert one(spark, "", terms) == []
    assert one(spark, "。！ ", terms) == []


def test_terms_of_a_very_long_text(spark):
    assert len(one(spark, "酒" * 50_000, terms)) == 99_999


def test_width_folding_is_part_of_nfkc():
    assert all(unicodedata.normalize("NFKC", a) == b for a, b in zip(WIDE, NARROW, strict=True))


def test_texts_folded_in_the_jvm_need_no_more():
    """No character that keeps a text out of Python changes under NFKC, alone or after another, but for width."""
    plain = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not re.fullmatch(NOT_PLAIN, c)]
    table = str.maketrans(WIDE, NARROW)
    assert len(plain) > 27_000 and all(unicodedata.normalize("NFKC", c) == c.translate(table) and not unicodedata.combining(c) for c in plain)
    assert unicodedata.normalize("NFKC", "".join(plain)) == "".join(plain).translate(table)


def test_whitespace_class_is_unicode_whitespace():
    space = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), SPACE))
    assert {c for c in map(chr, range(0x11000)) if space.fullmatch(c)} == {c for c in map(chr, range(0x11000)) if c.isspace()} - set("\x1c\x1d\x1e\x1f")


def test_nfkc_keeps_null(spark):
    assert one(spark, None, nfkc) is None
    assert one(spark, "ｶﾞ", nfkc) == "ガ"
    assert one(spark, "Ａ　１", fold_width) == "A 1"


def test_whitespace(spark):
    assert one(spark, " a　b\tc\n", squeeze) == "abc"
    assert one(spark, "　a \t b ", tidy) == "a b"


VOCABULARY = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", "酒", "un", "##aff", "##able", ",", "A"])}


def test_wordpiece():
    assert words("酒A, b\x00c\n") == ["酒", "A", ",", "bc"]
    assert pieces("unaffable", VOCABULARY) == ["un", "##aff", "##able"]
    assert pieces("unx", VOCABULARY) == ["[UNK]"]
    assert encode("酒unaffable", VOCABULARY) == [1, 3, 4, 5, 6, 2]
    assert encode(None, VOCABULARY) == [1, 2]
    assert encode("酒" * 600, VOCABULARY)[-1] == 2
    assert len(encode("酒" * 600, VOCABULARY)) == 512


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=40))
def test_wordpiece_never_fails(text):
    assert len(encode(text, VOCABULARY)) >= 2
    json.dumps(words(text))


# The strings on which two tokenizers are compared.
PARITY = [
    "贵州茅台2025年营业收入是多少？",
    "2025年年度报告中，五粮液的毛利率为 77.05%，同比+0.5pct。",
    "山西汾酒(600809) 省外市场收入 3,412,345,678.90 元",
    "泸州老窖 2026 上半年归母净利润同比 -12.3%",
    "合同负债/存货 turnover   ratio",
    "ROE、EPS、分红率：每股派息27.993元（含税）",
    "公司简称：贵州茅台；股票代码：600519。",
    "（一）主要经营情况【重大事项】《提示公告》",
    "ａｂｃ　全角空格　ＡＢＣ１２３",
    "茅台+五粮液=？ 100%＆*（",
    "A股  B股；H股",
    "",
    "   ",
    "毛利率\t营业收入\n净利润",
    "3.14159, 1,234,567.89, -0.5%, +15%",
    "洋河股份的\"合同负债\"是？",
    "①②③ Ⅰ Ⅱ Ⅲ 一、二、三",
    "2026年半年度报告（未经审计）",
    "www.cninfo.com.cn 巨潮资讯",
    "白酒行业: 茅台 / 五粮液 / 泸州老窖 / 山西汾酒 / 洋河股份",
]


def test_wordpiece_agrees_with_a_public_tokenizer():
    """Token by token on the parity strings, with a vocabulary of some of their characters and pieces."""
    tokenizers = pytest.importorskip("tokenizers")
    letters = sorted({c for t in PARITY for c in t if not c.isspace()} - set("窖Ⅲ＆"))
    known = ["[UNK]", "[CLS]", "[SEP]", *letters, *(f"##{c}" for c in letters if c.isalnum()), "turn", "##over", "20", "##25", "##26", "cn", "##info"]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(known))}
    other = tokenizers.Tokenizer(tokenizers.models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=100))
    other.normalizer = tokenizers.normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=False, lowercase=False)
    other.pre_tokenizer = tokenizers.pre_tokenizers.BertPreTokenizer()
    for text in PARITY:
        assert encode(text, vocabulary) == [1, *other.encode(text).ids, 2], text


def test_embedded_texts_have_length_one(spark):
    def make():
        return lambda texts: np.array([[len(t), t.count("酒"), 0.0] for t in texts])

    df = spark.createDataFrame([(1, "酒酒酒"), (2, ""), (3, None), (4, "白")], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", embedder(make, 2)(F.col("t")).alias("v")).collect()}
    assert got[1] == pytest.approx([0.5**0.5, 0.5**0.5, 0]) and got[2] == got[3] == [0, 0, 0] and got[4] == [1, 0, 0]
