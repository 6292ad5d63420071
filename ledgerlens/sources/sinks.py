"""Sinks: JSON lines, compact index shards, quantised vectors, document lengths and Markdown reports."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.index import decoded, dictionary, encoded
from ledgerlens.operators.search import quantized
from ledgerlens.runtime import cut_lineage

#: First bytes of an index shard.
MAGIC = b"LLX1"


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines; null fields are left out."""
    chunks.write.mode("overwrite").json(path)


def write_parsed(parsed: DataFrame, path: str) -> None:
    """Parsed reports as JSON in a folder per company code and period, both taken from the key."""
    parts = F.split("key", "_")
    parsed.withColumn("code", parts[0]).withColumn("period", parts[1]).write.mode("overwrite").partitionBy("code", "period").json(path)


def put_varint(n: int) -> bytes:
    """An unsigned number in seven-bit groups, lowest first; all but the last have the high bit."""
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at ``at`` and the place after it."""
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return n, at


def index_shards(gaps: DataFrame) -> DataFrame:
    """``terms``, ``payload``: compressed binary shards of an index, one per task, terms in order.

    ``gaps`` has ``term``, ``idx``, ``gap``, ``tf``. A shard is MAGIC, the number of entries, then entries of
    term length, term, block, postings and (gap, tf) varints; a term's entries are one per posting block, so
    none grows with the collection.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        body, entries, terms, key, pairs = bytearray(), 0, 0, None, []

        def close() -> None:
            nonlocal entries
            word = key[0].encode()
            body.extend(put_varint(len(word)) + word + put_varint(key[1]) + put_varint(len(pairs)) + b"".join(put_varint(g) + put_varint(t) for g, t in pairs))
            entries += 1

        for batch in batches:
            for term, idx, gap, tf in zip(batch["term"], batch["idx"], batch["gap"], batch["tf"], strict=True):
                here = (term, idx >> 12)
                if here != key:
                    if key is not None:
                        close()
                    terms += key is None or term != key[0]
                    key, pairs = here, []
                pairs.append((gap, tf))
        if key is not None:
            close()
            yield pd.DataFrame({"terms": [terms], "payload": [MAGIC + struct.pack("<I", entries) + zlib.compress(bytes(body))]})

    in_order = gaps.repartitionByRange("term").sortWithinPartitions("term", "idx")
    return in_order.mapInPandas(pack, "terms long, payload binary")


def read_shards(shards: DataFrame) -> DataFrame:
    """``term``, ``idx``, ``tf`` of index shards."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for payload in batch["payload"]:
                if payload[:4] != MAGIC:
                    raise ValueError("not an index shard")
                (entries,) = struct.unpack_from("<I", payload, 4)
                body, at, out = zlib.decompress(payload[8:]), 0, []
                for _ in range(entries):
                    size, at = get_varint(body, at)
                    term, at = body[at : at + size].decode(), at + size
                    block, at = get_varint(body, at)
                    n, at = get_varint(body, at)
                    idx = block << 12
                    for _ in range(n):
                        gap, at = get_varint(body, at)
                        tf, at = get_varint(body, at)
                        idx += gap
                        out.append((term, idx, tf))
                yield pd.DataFrame(out, columns=["term", "idx", "tf"])

    return shards.mapInPandas(unpack, "term string, idx long, tf long")


def write_vectors(vectors: DataFrame, key: str, vector: str, path: str) -> None:
    """Vectors quantised to bytes, by key."""
    vectors.select(key, quantized(F.col(vector)).alias("codes")).write.mode("overwrite").parquet(path)


def write_lengths(lengths: DataFrame, path: str) -> None:
    """Document lengths as integers, by key."""
    lengths.select("idx", F.col("dl").cast("int").alias("dl")).write.mode("overwrite").parquet(path)


def write_site(chunks: DataFrame, path: str, columns: dict[str, str | None]) -> None:
    """Chunks with ``columns`` as codes under ``path/chunks``, the dictionaries under ``path/dictionary``, and one row of ``path/meta``: chunks and the size of each dictionary.

    ``columns`` names, for each column, the one whose order gives its codes (first seen first), or None for sorted values.
    """
    known = {name: cut_lineage(dictionary(chunks, name, order)) for name, order in columns.items()}
    encoded(chunks, known).write.mode("overwrite").parquet(f"{path}/chunks")
    for name, values in known.items():
        values.write.mode("overwrite").parquet(f"{path}/dictionary/column={name}")
    sizes = [F.lit(values.count()).alias(f"{name}_values") for name, values in known.items()]
    chunks.agg(F.count("*").alias("chunks"), *sizes).write.mode("overwrite").json(f"{path}/meta")


def read_site(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of write_site() with their values."""
    values = spark.read.parquet(f"{path}/dictionary")
    names = [r[0] for r in values.select("column").distinct().collect()]
    return decoded(spark.read.parquet(f"{path}/chunks"), {name: values.where(F.col("column") == name).select("value", "code") for name in names})


def write_evaluation(questions: DataFrame, summary: DataFrame, path: str) -> None:
    """Evaluated questions and their summary as JSON lines under ``path/questions`` and ``path/summary``."""
    questions.orderBy("id").write.mode("overwrite").json(f"{path}/questions")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_manifest(rows: DataFrame, totals: DataFrame, path: str) -> None:
    """Manifest rows by company code and period, and their totals, as JSON lines under ``path/reports`` and ``path/totals``."""
    ordered(rows).write.mode("overwrite").json(f"{path}/reports")
    totals.write.mode("overwrite").json(f"{path}/totals")


def ordered(rows: DataFrame) -> DataFrame:
    """Manifest rows in the order of company code and period, both parts of the key."""
    return rows.orderBy(F.split("key", "_")[0], F.split("key", "_")[1], "key")


def by_revenue(rows: DataFrame) -> DataFrame:
    """Rows of a report's table from the largest revenue down, those without one among zeros."""
    return rows.orderBy(F.coalesce("revenue", F.lit(0.0)).desc(), "code")


def markdown_report(title: str, tables: dict[str, DataFrame], most: int | None = None) -> str:
    """A report for people: each result as a Markdown table, in the result's order if it is sorted, else by its first column.

    Reports hold everything; with ``most``, only so many rows of each table, and how many more there are. Rows are fetched
    partition by partition.
    """
    parts = [f"# {title}"]
    for name, df in tables.items():
        count = df.count() if most is not None else 0
        rows = df if df._jdf.queryExecution().analyzed().nodeName() == "Sort" else df.orderBy(df.columns[0])
        rows = rows.limit(most) if most is not None else rows
        lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        lines += ["| " + " | ".join("—" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows.toLocalIterator()]
        more = f"\n\n{count - most} more rows." if most is not None and count > most else ""
        parts.append(f"## {name}\n\n" + "\n".join(lines) + more)
    return "\n\n".join(parts) + "\n"
