"""Oversized texts cut into overlapping pieces at lexical-cohesion valleys."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text on either side of a boundary whose vocabulary is compared.
BLOCK = 160
#: A piece is at least this share of the room there is, so that pieces don't become crumbs.
LEAST_SHARE = 0.45
_BUCKETS = 512
# Boundaries from strong to weak: paragraph or table row, sentence, clause, word.
_LEVELS = (re.compile(r"\n+"), re.compile(r"[。！？!?；;…]+[”’」』）)\"']*|\.(?=\s|$)"), re.compile(r"[，,、：:]"), re.compile(r"\s"))


def boundaries(text: str) -> list[np.ndarray]:
    """Places after which the text may be cut, by level: paragraph or row, sentence, clause, word."""
    return [np.array([m.end() for m in level.finditer(text) if m.end() < len(text)], dtype=np.int64) for level in _LEVELS]


def _vocabulary(text: str) -> np.ndarray:
    """Running counts of hashed character pairs: row i counts the pairs that start before character i."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    pair = ((codes[:-1] * np.uint64(0x9E3779B1) + codes[1:]) * np.uint64(0x85EBCA77) >> np.uint64(13)) % np.uint64(_BUCKETS)
    return pair.astype(np.int64)


def cohesion(text: str, places: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Similarity of the blocks of text before and after each place: cosine of their character-pair counts."""
    pair = _vocabulary(text)
    out = np.empty(len(places))
    for k, p in enumerate(places):
        left = np.bincount(pair[max(0, p - block) : max(0, p - 1)], minlength=_BUCKETS).astype(float)
        right = np.bincount(pair[p : p + block - 1], minlength=_BUCKETS).astype(float)
        size = np.sqrt((left @ left) * (right @ right))
        out[k] = left @ right / size if size else 0.0
    return out


def depths(similarity: np.ndarray) -> np.ndarray:
    """Depth of each valley: how far the similarity climbs to the nearest peak on the left plus on the right.

    A climb goes on while the next value is not lower and ends where it falls.
    """
    left, right = similarity.copy(), similarity.copy()
    for k in range(1, len(similarity)):
        if similarity[k - 1] >= similarity[k]:
            left[k] = left[k - 1]
    for k in range(len(similarity) - 2, -1, -1):
        if similarity[k + 1] >= similarity[k]:
            right[k] = right[k + 1]
    return left + right - 2 * similarity


def split_text(text: str, most: int = 1100, overlap: tuple[int, int] = (80, 150), block: int = BLOCK) -> list[tuple[int, int]]:
    """Start and end of each piece of ``text``: pieces of at most ``most`` characters that together hold all of it.

    A piece after the first opens with the last ``overlap`` characters of the one before, from a sentence or
    clause start where there is one in that range. The end of each piece is the deepest cohesion valley among
    the strongest boundaries in its size window; where the window holds no boundary at all, the piece is full. The
    window also ends early enough to leave the last piece a fair share of new text.
    """
    low, high = overlap
    if not 0 <= low <= high < most * LEAST_SHARE:
        raise ValueError("the overlap must be well below the size limit")
    n = len(text)
    if n <= most:
        return [(0, n)]
    levels = boundaries(text)
    natural = np.union1d(levels[0], levels[1])
    deep = depths(cohesion(text, natural, block)) if len(natural) else np.empty(0)
    weak = [levels[2], levels[3]]
    starts = np.union1d(natural, levels[2])
    pieces, start = [], 0
    least = max(high + 1, int(most * LEAST_SHARE))
    while n - start > most:
        first, last = start + least, min(start + most, n - (least - high))
        a, b = np.searchsorted(natural, [first, last + 1])
        if a < b:
            best = deep[a:b]
            end = int(natural[a:b][np.flatnonzero(best >= best.max() - 1e-12)[-1]])
        else:
            inside = next((x for w in weak if len(x := w[(w >= first) & (w <= last)])), None)
            end = int(inside[-1]) if inside is not None else last
        pieces.append((start, end))
        lo, hi = end - high, end - low
        ok = starts[(starts >= lo) & (starts <= hi)]
        start = int(ok[0]) if len(ok) else end - (low + high) // 2
    pieces.append((start, n))
    return pieces


def split_oversized(df: DataFrame, record: str, text: str, carry: list[str], most: int = 1100, overlap: tuple[int, int] = (80, 150)) -> DataFrame:
    """Pieces of all texts longer than ``most`` characters: ``record``, ``piece`` from 1, ``carry``, ``start``, ``text``.

    Sliding blocks are compared at every paragraph, table-row and sentence end; the depth of a fall in their
    similarity marks a change of topic, and each piece ends at the deepest valley of its size window. See
    split_text().

    Defined cases: only the text's own length counts; null, empty and shorter texts give no rows; repeated rows
    come out once, different texts of one record each come out; rows without record id take no part; a text of
    any length is cut, also without any boundary; other columns are ignored.
    """
    rows = df.select(F.col(record), *carry, F.col(text).alias("text")).where(F.col(record).isNotNull() & (F.char_length("text") > most)).distinct()
    schema = T.StructType([rows.schema[record], T.StructField("piece", T.IntegerType()), *(rows.schema[c] for c in carry), T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t, *own in zip(batch[record], batch["text"], *(batch[c].astype(object).where(batch[c].notna(), None) for c in carry), strict=True):
                out += [(i, k, *own, a, t[a:b]) for k, (a, b) in enumerate(split_text(t, most, overlap), 1)]
            yield pd.DataFrame(out, columns=schema.names)

    return rows.mapInPandas(cut, schema)
