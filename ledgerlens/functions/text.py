"""Text expressions: Unicode folding, whitespace handling and the CJK-aware term tokenizer."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The full-width forms U+FF01 to U+FF5E and the ideographic space, with their ASCII counterparts.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "

# Fixed value: the characters of Unicode's whitespace property, as a class; an explicit class is matched much faster than the property.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# The character classes of the tokenizer.
CJK = "㐀-䶿一-鿿"
RUNS = f"[{CJK}豈-﫿]+|[a-z0-9][a-z0-9.%,]*|[À-ɏ]+"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC of each value; null stays null. Spark has no such built-in."""
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def fold_width(text: Column) -> Column:
    """Full-width ASCII forms made narrow, inside the JVM; the part of NFKC that report text needs."""
    return F.translate(text, WIDE, NARROW)


def squeeze(text: Column) -> Column:
    """All whitespace removed, Unicode whitespace included."""
    return F.regexp_replace(text, SPACE + "+", "")


def tidy(text: Column) -> Column:
    """Outer whitespace removed and each inner run made one space."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def runs(text: Column) -> Column:
    """The token runs of lower-cased text, in order; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({RUNS})"), F.lit(1))


def terms(text: Column, normalise: bool = True) -> Column:
    """Search terms of a text, in the order of its runs.

    A run that starts with a CJK character gives each of its characters and then each pair of neighbours; any
    other run is one term. With ``normalise`` the text goes through NFKC in Python first; without it only
    full-width forms are folded, which keeps the expression inside the JVM.
    """
    return folded_terms(folded(text, normalise))


# Fixed value: all but the characters that NFKC leaves as they are next to each other, or changes as fold_width() does.
NOT_PLAIN = f"[^\\x00-\\x7f、-】—‘-”{CJK}！-～　]"


def folded(text: Column, normalise: bool = True) -> Column:
    """Lower-cased text after NFKC, or after folding of full-width forms only.

    Texts without NOT_PLAIN characters are folded in the JVM, which gives the same; only the others go through Python.
    """
    if not normalise:
        return F.lower(fold_width(text))
    rest = F.when(text.rlike(NOT_PLAIN), text)
    return F.lower(F.coalesce(nfkc(rest), fold_width(text)))


def folded_terms(text: Column) -> Column:
    """The terms of text that is folded already; stays inside the JVM."""

    def expand(run: Column) -> Column:
        n = F.char_length(run)
        ones = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(run, i, F.lit(1)))
        twos = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(f"^[{CJK}]"), F.concat(ones, twos)).otherwise(F.array(run))

    return F.flatten(F.transform(runs(text), expand))


_RUN, _HAN = re.compile(RUNS), re.compile(f"[{CJK}]")


def terms_of(folded: str) -> list[str]:
    """What folded_terms() gives, for Python code that needs the terms of a text where it stands."""
    out: list[str] = []
    for run in _RUN.findall(folded):
        if _HAN.match(run):
            out += run
            out += map("".join, zip(run, run[1:], strict=False))
        else:
            out.append(run)
    return out
