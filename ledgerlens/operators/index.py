"""The BM25 index: term frequencies, statistics, posting blocks, and its compact encodings."""

from __future__ import annotations

import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.functions.text import folded, folded_terms, terms_of
from ledgerlens.functions.vocabulary import MIN_DF
from ledgerlens.plans.ranking import number_all, running_total
from ledgerlens.runtime import broadcast_if_small, cut_lineage

#: Documents per posting block, as a power of two: a common term's postings are spread over blocks of bounded size.
BLOCK_BITS = 12


def _joined() -> Column:
    """The non-empty ones of section, subsection and text, joined by spaces."""
    return F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("section", "subsection", "text")))


def index_text(df: DataFrame, normalise: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``idx``, the columns ``keep`` and the indexed ``body`` of each different chunk: its non-empty section, subsection and text, joined by spaces and folded.

    Repeated rows count once; rows without idx are left out; a chunk with nothing to index has empty text. Folding
    comes first, then the rows are partitioned by idx, which serves both the removal of repeats and all later counts
    per (idx, term): those need no further shuffle.
    """
    return df.where("idx is not null").select("idx", *keep, folded(_joined(), normalise).alias("body")).repartition("idx").distinct()


def raw_rows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """raw_text() where the rows stand, with repeats, for those who remove them after they have counted."""
    return df.where("idx is not null").select("idx", *keep, _joined().alias("raw"))


def raw_text(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """index_text() before it is folded, as ``raw``, for those who fold and count it in one step."""
    return raw_rows(df, keep).repartition("idx").distinct()


def tokenized(df: DataFrame, normalise: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``idx``, the columns ``keep``, ``terms`` in order and their number ``dl``."""
    return index_text(df, normalise, keep).select("idx", *keep, folded_terms(F.col("body")).alias("terms")).withColumn("dl", F.size("terms").cast("long"))


def exploded(tokens: DataFrame, *keep: str) -> DataFrame:
    """One row per term occurrence: ``keep`` and ``term``.

    The outer form is used since for the plain one the optimizer adds a filter on the array's size, which it pushes
    below the shuffle and so tokenizes every text twice.
    """
    return tokens.select(*keep, F.explode_outer("terms").alias("term")).where("term is not null")


def term_freq(tokens: DataFrame) -> DataFrame:
    """``term``, ``idx``, ``tf``; counted within the tasks that hold the documents."""
    return exploded(tokens, "idx").groupBy("idx", "term").agg(F.count("*").alias("tf")).select("term", "idx", "tf")


def term_counts(tokens: DataFrame) -> DataFrame:
    """``term``, its document frequency ``df`` and its occurrences ``cf``; a document's repeats are counted before the shuffle."""
    own = term_freq(tokens)
    return own.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: documents ``n``, total terms, mean length ``avgdl``; documents without terms count with length 0."""
    return tokens.agg(F.count("*").alias("n"), F.sum("dl").alias("terms"), F.round(F.avg("dl"), 6).alias("avgdl"))


def idf_of(n: Column, df: Column) -> Column:
    """Inverse document frequency, never negative."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf(tokens: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """``term``, ``df``, ``idf`` of terms in at least ``min_df`` documents."""
    n = tokens.count()
    counts = exploded(tokens.select(F.array_distinct("terms").alias("terms"))).groupBy("term").agg(F.count("*").alias("df"))
    return counts.where(F.col("df") >= min_df).withColumn("idf", F.round(idf_of(F.lit(n), F.col("df")), 6))


def block_of(idx: Column) -> Column:
    """The posting block of a document."""
    return F.shiftright(idx, BLOCK_BITS)


def posting_lists(tokens: DataFrame) -> DataFrame:
    """``term``, ``block``, ``n`` and ``postings`` (``idx``, ``tf`` in order). A row holds at most 2 ** BLOCK_BITS documents, so a term that every document has is many rows."""
    lists = term_freq(tokens).groupBy("term", block_of(F.col("idx")).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "tf"))).alias("postings"))
    return lists.select("term", "block", F.size("postings").cast("long").alias("n"), "postings")


def posting_blocks(tokens: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """``term``, ``block``, ``n`` and ``postings`` (``idx:tf`` in order, space-separated) of terms in at least ``min_df`` documents.

    Lists are built once. A block of ``min_df`` documents shows that its term has enough; only the smaller blocks are
    joined to the terms' totals, so no long list is moved again.
    """
    lists = cut_lineage(posting_lists(tokens))
    enough = lists.groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") >= min_df).select("term")
    text = F.array_join(F.transform("postings", lambda x: F.concat_ws(":", x["idx"], x["tf"])), " ")
    kept = lists.where(F.col("n") >= min_df).unionByName(lists.where(F.col("n") < min_df).join(enough, "term", "left_semi"))
    return kept.select("term", "block", "n", text.alias("postings"))


def block_text(df: DataFrame) -> DataFrame:
    """raw_text() with its posting ``block``, by which it is partitioned."""
    return df.where("idx is not null").select(block_of(F.col("idx")).alias("block"), "idx", _joined().alias("raw")).repartition("block").distinct()


#: A row of a stored index: a block's postings of a term, or without term its documents with their lengths as ``tfs``.
STORED = "term string, block long, n long, total long, gaps binary, tfs binary"


def packed(idx: Iterable[int], counts: Iterable[int], block: int) -> tuple[bytes, bytes]:
    """A block's documents in order as gaps of two bytes, and a number for each: a byte, or eight where one doesn't fit."""
    at, counts = np.fromiter(idx, dtype=np.int64) - (block << BLOCK_BITS), np.fromiter(counts, dtype=np.int64)
    return np.diff(at, prepend=0).astype("<u2").tobytes(), counts.astype("u1" if counts.max(initial=0) < 256 else "<i8").tobytes()


def unpacked(gaps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The documents' places in their block, and the numbers."""
    at = np.cumsum(np.frombuffer(gaps, dtype="<u2").astype(np.int64))
    return at, np.frombuffer(counts, dtype="u1" if len(counts) == len(at) else "<i8").astype(np.int64)


def write_index(texts: DataFrame, path: str) -> None:
    """A searchable index under ``path`` of block_text(): packed postings, terms in order within a file so that readers skip what they don't ask for, and lengths.

    A block's texts stand in one task, which counts and packs them; no term is moved or written but in its packed postings.
    An idx with several texts has their terms together, and the length of each.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, postings, lengths, last, own = None, {}, [], None, Counter()

        def close() -> None:
            for term, tf in own.items():
                held = postings.get(term)
                if held is None:
                    held = postings[term] = array("q")
                held.append(last)
                held.append(tf)
            own.clear()

        def rows() -> Iterator[pd.DataFrame]:
            close()
            out = [(term, block, len(x) // 2, sum(x[1::2]), *packed(x[::2], x[1::2], block)) for term, x in postings.items()]
            out.append((None, block, len(lengths), sum(n for _, n in lengths), *packed((i for i, _ in lengths), (n for _, n in lengths), block)))
            for at in range(0, len(out), 10_000):
                yield pd.DataFrame(out[at : at + 10_000], columns=["term", "block", "n", "total", "gaps", "tfs"])

        for batch in batches:
            for own_block, idx, text in zip(batch["block"], batch["idx"], batch["raw"], strict=True):
                if block is not None and own_block != block:
                    yield from rows()
                    postings, lengths, last = {}, [], None
                block = own_block
                if idx != last:
                    close()
                    last = idx
                found = terms_of(unicodedata.normalize("NFKC", text).lower())
                own.update(found)
                lengths.append((idx, len(found)))
        if block is not None:
            yield from rows()

    texts.select("block", "idx", "raw").sortWithinPartitions("block", "idx").mapInPandas(build, STORED).sortWithinPartitions("term", "block").write.mode("overwrite").option("compression", "zstd").parquet(path)


def varint_length(n: Column) -> Column:
    """Bytes that an unsigned number below 2 ** 35 takes in seven-bit groups."""
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5).cast("long")


def encode_gaps(tokens: DataFrame, tf_cap: int | None = None) -> DataFrame:
    """``term``, ``idx``, ``gap`` to the block's previous document (or the block's start), ``tf`` and ``bytes`` of both as varints.

    ``tf_cap`` is the largest frequency that is kept, for exports that want one; by default all are kept.
    """
    rows = term_freq(tokens).withColumn("block", block_of(F.col("idx")))
    before = F.lag("idx").over(W.partitionBy("term", "block").orderBy("idx"))
    gaps = rows.withColumn("gap", F.col("idx") - F.coalesce(before, F.shiftleft("block", BLOCK_BITS)))
    capped = gaps if tf_cap is None else gaps.withColumn("tf", F.least(F.col("tf"), F.lit(tf_cap).cast("long")))
    return capped.select("term", "idx", "gap", "tf", (varint_length(F.col("gap")) + varint_length(F.col("tf"))).alias("bytes"))


def decode_gaps(encoded: DataFrame) -> DataFrame:
    """``term``, ``idx``, ``decoded``: documents recovered from the gaps alone."""
    rows = encoded.withColumn("block", block_of(F.col("idx")))
    running = F.sum("gap").over(W.partitionBy("term", "block").orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("term", "idx", (F.shiftleft("block", BLOCK_BITS) + running).alias("decoded"))


def posting_offsets(encoded: DataFrame) -> DataFrame:
    """``term``, ``df``, ``bytes`` and the byte ``offset`` at which its postings start when terms follow in order."""
    sizes = encoded.groupBy("term").agg(F.count("*").alias("df"), F.sum("bytes").alias("bytes"))
    return running_total(sizes, [F.col("term")], "bytes", "offset")


def dictionary(df: DataFrame, column: str, order_by: str | None = None) -> DataFrame:
    """``value`` and ``code`` from 0 of a column's different non-null values: sorted, or by first appearance in ``order_by``."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
    if order_by is None:
        return number_all(values.agg(F.count("*").alias("n")).drop("n"), [F.col("value")], "code")
    return number_all(values.agg(F.min(order_by).alias("first")), [F.col("first"), F.col("value")], "code").drop("first")


def encoded(df: DataFrame, columns: dict[str, DataFrame]) -> DataFrame:
    """``df`` with each column of ``columns`` replaced by its code in the dictionary given for it; null stays null.

    A dictionary is broadcast after it has been counted.
    """
    for name, values in columns.items():
        known = values.select(F.col("value").alias(name), F.col("code").alias("__code"))
        df = df.join(broadcast_if_small(known, values.count()), name, "left").withColumn(name, F.col("__code")).drop("__code")
    return df


def decoded(df: DataFrame, columns: dict[str, DataFrame]) -> DataFrame:
    """The opposite of encoded()."""
    for name, values in columns.items():
        known = values.select(F.col("code").alias(name), F.col("value").alias("__value"))
        df = df.join(broadcast_if_small(known, values.count()), name, "left").withColumn(name, F.col("__value")).drop("__value")
    return df


def embed_text(df: DataFrame, chars: int = 1500) -> Column:
    """What an encoder reads of a chunk: its non-empty name, period, section and subsection, a line feed, its text; cut to ``chars``."""
    head = F.concat_ws(" ", *(F.nullif(df[c], F.lit("")) for c in ("name", "period", "section", "subsection")))
    return F.substring(F.concat(head, F.lit("\n"), F.coalesce(df["text"], F.lit(""))), 1, chars)
