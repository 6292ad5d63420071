"""Frequencies of every distinct term, kept as compressed record bitmaps with parallel occurrence counters."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Records that one bitmap container covers: 2 ** 16, so that a record's place in it takes two bytes.
BLOCK_BITS = 16
#: Characters of text that a task gathers before it writes its containers.
HELD_CHARS = 6_000_000
_WORDS = re.compile(r"[a-z]{2,}")
_FIRST, _LAST = 0x4E00, 0x9FFF
_SPACE = re.compile(r"\s+")


def _pair_postings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of adjacent characters from U+4E00 to U+9FFF: its code and the number of its text."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    han = (codes >= _FIRST) & (codes <= _LAST)
    at = np.flatnonzero(han[:-1] & han[1:]) if len(codes) > 1 else np.empty(0, dtype=np.int64)
    base = codes.astype(np.int64) - _FIRST
    return (base[at] << 16) | base[at + 1], np.searchsorted(starts, at, side="right") - 1


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """A container: sorted places (0 to 65535) as an array or a bitmap, whichever is smaller, and their counts, deflated.

    Counts are a parallel sparse list: only records in which the term occurs more than once have an entry.
    """
    more = np.flatnonzero(counts > 1)
    gaps = np.diff(places, prepend=0).astype(np.uint16)
    if len(places) > 4096:
        bits = np.zeros(1 << BLOCK_BITS, dtype=bool)
        bits[places] = True
        body, kind = np.packbits(bits).tobytes(), 1
    else:
        body, kind = gaps.tobytes(), 0
    head = np.array([kind, len(places), len(more)], dtype=np.uint32).tobytes()
    raw = head + body + np.diff(more, prepend=0).astype(np.uint16).tobytes() + np.minimum(counts[more], 2**32 - 1).astype(np.uint32).tobytes()
    return raw if len(raw) < 40 else b"z" + zlib.compress(raw, 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted places and their counts."""
    raw = zlib.decompress(data[1:]) if data[:1] == b"z" else data
    kind, n, extra = np.frombuffer(raw, dtype=np.uint32, count=3)
    at = 12
    if kind:
        size = (1 << BLOCK_BITS) // 8
        places = np.flatnonzero(np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=size, offset=at)))
    else:
        size = 2 * int(n)
        places = np.cumsum(np.frombuffer(raw, dtype=np.uint16, count=n, offset=at), dtype=np.int64)
    at += size
    counts = np.ones(n, dtype=np.int64)
    if extra:
        where = np.cumsum(np.frombuffer(raw, dtype=np.uint16, count=extra, offset=at), dtype=np.int64)
        counts[where] = np.frombuffer(raw[at + 2 * int(extra) :], dtype=np.uint32, count=extra)
    return places, counts


def union(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of several containers of one term and block; a record in several of them counts once, with its highest count."""
    if len(parts) == 1:
        return unpack(parts[0])
    open_parts = [unpack(p) for p in parts]
    places, counts = np.concatenate([p for p, _ in open_parts]), np.concatenate([c for _, c in open_parts])
    order = np.lexsort((-counts, places))
    places, counts = places[order], counts[order]
    first = np.r_[True, places[1:] != places[:-1]] if len(places) else np.empty(0, dtype=bool)
    return places[first], counts[first]


def _containers(field: str, terms: np.ndarray, codes: np.ndarray, records: np.ndarray) -> Iterator[tuple]:
    """One row per (term, block) of the postings (code, record); terms[code] is the term's text."""
    if not len(codes):
        return
    order = np.lexsort((records, codes))
    codes, records = codes[order], records[order]
    start = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (records[1:] != records[:-1])])
    counts = np.diff(np.r_[start, len(codes)])
    codes, records = codes[start], records[start]
    blocks, places = records >> BLOCK_BITS, records & ((1 << BLOCK_BITS) - 1)
    edge = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])])
    for a, b in zip(edge, np.r_[edge[1:], len(codes)], strict=True):
        yield field, terms[codes[a]], int(blocks[a]), pack(places[a:b], counts[a:b])


def _rows(held: dict[int, tuple[str, str]]) -> pd.DataFrame:
    ids, texts, sections = list(held), [t for t, _ in held.values()], [v for _, v in held.values()]
    records = np.array(ids, dtype=np.int64)
    pairs, text_of = _pair_postings(texts)
    known, codes = np.unique(pairs, return_inverse=True)
    names = np.stack([(known >> 16) + _FIRST, (known & 0xFFFF) + _FIRST], axis=1).astype(np.uint32)
    out = list(_containers("text", np.ascontiguousarray(names).view("<U2").ravel(), codes, records[text_of]))
    words: dict[str, int] = {}
    found = [(words.setdefault(w, len(words)), i) for i, t in zip(ids, texts, strict=True) for w in _WORDS.findall(t)]
    if found:
        out += _containers("text", np.array(list(words), dtype=object), *np.array(found, dtype=np.int64).T)
    values: dict[str, int] = {}
    found = [(values.setdefault(s, len(values)), i) for i, s in zip(ids, sections, strict=True) if s]
    if found:
        out += _containers("section", np.array(list(values), dtype=object), *np.array(found, dtype=np.int64).T)
    return pd.DataFrame(out, columns=["field", "term", "block", "bitmap"])


def term_bitmaps(df: DataFrame, record: str, text: str, value: str | None = None) -> DataFrame:
    """Compressed record bitmaps of all terms: ``field``, ``term``, ``block``, ``bitmap``, one row per task and container.

    Terms of ``text`` (field ``text``) are, after NFKC and lower-casing, each pair of adjacent characters from
    U+4E00 to U+9FFF and each longest run of two or more letters a-z; the column ``value`` gives its whole value,
    after NFKC, lower-casing and removal of all whitespace, as one term (field ``section``). Tasks turn the rows
    of their own partition into containers; no text is shuffled.
    """
    columns = [F.col(record).cast("long").alias("record"), F.col(text).cast("string").alias("text"), (F.col(value).cast("string") if value else F.lit(None).cast("string")).alias("value")]
    rows = df.select(*columns).where(F.col("record").isNotNull())

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[str, str]] = {}
        chars = 0
        for batch in batches:
            for i, t, v in zip(batch["record"], batch["text"], batch["value"], strict=True):
                t = unicodedata.normalize("NFKC", t).lower() if t else ""
                v = _SPACE.sub("", unicodedata.normalize("NFKC", v).lower()) if v else ""
                if i in held and held[i] == (t, v):
                    continue  # a repeated row
                if i in held or chars > HELD_CHARS:
                    yield _rows(held)
                    held, chars = {}, 0
                held[i] = (t, v)
                chars += len(t)
        if held:
            yield _rows(held)

    return rows.mapInPandas(build, "field string, term string, block long, bitmap binary")


def merged_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """One container per term and block, by union: ``field``, ``term``, ``block``, ``bitmap``, ``records``, ``occurrences``.

    Rows meet by term and block, so that a term in every record is spread over as many tasks as there are blocks.
    """

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        parts: list[bytes] = []

        def one() -> tuple:
            if len(parts) == 1:
                places, counts = unpack(parts[0])
                return *key, parts[0], len(places), int(counts.sum())
            places, counts = union(parts)
            return *key, pack(places, counts), len(places), int(counts.sum())

        for batch in batches:
            out = []
            for field, term, block, bitmap in zip(batch["field"], batch["term"], batch["block"], batch["bitmap"], strict=True):
                if key != (field, term, block):
                    if parts:
                        out.append(one())
                    key, parts = (field, term, block), []
                parts.append(bitmap)
            yield pd.DataFrame(out, columns=["field", "term", "block", "bitmap", "records", "occurrences"])
        if parts:
            yield pd.DataFrame([one()], columns=["field", "term", "block", "bitmap", "records", "occurrences"])

    ordered = bitmaps.repartition("field", "term", "block").sortWithinPartitions("field", "term", "block")
    return ordered.mapInPandas(merge, "field string, term string, block long, bitmap binary, records long, occurrences long")


def term_counts(df: DataFrame, record: str, text: str, value: str | None = None, common_share: float = 0.4) -> DataFrame:
    """Every term's counts: ``field``, ``term``, ``occurrences``, ``records`` and ``mark``.

    ``records`` is the cardinality of the term's bitmap, ``occurrences`` the sum of its parallel counters;
    ``mark`` is ``rare`` for terms in exactly one record, ``common`` for those in more than ``common_share`` of
    all records, else null.

    Defined cases: null and empty texts hold no terms, but their records count among all records; repeated rows
    count once, rows of one record with different texts count by the higher count per term; rows without record
    number take no part; an empty table gives an empty result.
    """
    merged = merged_bitmaps(term_bitmaps(df, record, text, value))
    counts = merged.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    everything = df.select(F.col(record).cast("long").alias("record")).where(F.col("record").isNotNull()).distinct().count()
    return counts.withColumn("mark", _mark(F.col("records"), F.lit(everything), common_share))


def _mark(records: Column, everything: Column, common_share: float) -> Column:
    return F.when(records == 1, "rare").when(records > F.lit(common_share) * everything, "common")
