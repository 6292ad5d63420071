"""WordPiece encoding with a given vocabulary: longest match first, CJK characters and punctuation on their own."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code ranges whose characters are words of their own.
_ALONE = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
# Special tokens.
CLS, SEP, UNK, PREFIX = "[CLS]", "[SEP]", "[UNK]", "##"
#: Longest word that is looked up, longest sequence.
WORD_LIMIT, SEQUENCE_LIMIT = 100, 512


def _alone(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in _ALONE) or unicodedata.category(c).startswith("P") or c in "$+<=>^`|~"


def words(text: str) -> list[str]:
    """Words of a text: control characters dropped, split at whitespace, lone characters cut out; case is kept."""
    out, word = [], ""
    for c in text:
        if c in "\t\n\r" or c.isspace():
            c = " "
        elif ord(c) in (0, 0xFFFD) or unicodedata.category(c) in ("Cc", "Cf"):
            continue
        if c == " " or _alone(c):
            if word:
                out.append(word)
            word = ""
            if c != " ":
                out.append(c)
        else:
            word += c
    return [*out, word] if word else out


def pieces(word: str, vocabulary: dict[str, int]) -> list[str]:
    """The longest known pieces of a word from left to right; the unknown token where one is missing or the word is too long."""
    if len(word) > WORD_LIMIT:
        return [UNK]
    found, start = [], 0
    while start < len(word):
        end = next((e for e in range(len(word), start, -1) if (PREFIX if start else "") + word[start:e] in vocabulary), None)
        if end is None:
            return [UNK]
        found.append((PREFIX if start else "") + word[start:end])
        start = end
    return found


def encode(text: str | None, vocabulary: dict[str, int], limit: int = SEQUENCE_LIMIT) -> list[int]:
    """Token numbers between the start and the end token, at most ``limit``; null is the empty text."""
    body = [p for w in words(text or "") for p in pieces(w, vocabulary)]
    return [vocabulary[t] for t in [CLS, *body[: limit - 2], SEP]]


def wordpiece(vocabulary: dict[str, int], limit: int = SEQUENCE_LIMIT):
    """A column function that encodes texts in Arrow batches; the vocabulary, of fixed size, travels with it."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: encode(t, vocabulary, limit))

    def apply(text: Column) -> Column:
        return run(text)

    return apply
