"""Incremental index: new chunks arrive as a stream, their term counts are appended, readers merge them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators.index import term_freq, tokenized
from ledgerlens.runtime import cut_lineage
from ledgerlens.sources.readers import CHUNK


def chunk_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of chunk files (JSON lines with ``idx``)."""
    return spark.readStream.schema(f"idx bigint, {CHUNK}").option("maxFilesPerTrigger", files_per_trigger).json(path)


def index_stream(chunks: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's postings and chunk lengths to ``sink``, in a folder per batch that a repeated batch overwrites; ends when the input is used up.

    A chunk without terms has a length as well, so that it takes the place of its earlier versions.
    """

    def add(batch: DataFrame, number: int) -> None:
        tokens = cut_lineage(tokenized(batch))
        term_freq(tokens).write.mode("overwrite").parquet(f"{sink}/postings/batch={number}")
        tokens.select("idx", "dl").write.mode("overwrite").parquet(f"{sink}/lengths/batch={number}")

    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(spark: SparkSession, sink: str) -> DataFrame:
    """``term``, ``df``, ``cf`` over all batches; a chunk that came in several batches counts once, by its last."""
    last = spark.read.parquet(f"{sink}/lengths").groupBy("idx").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{sink}/postings").join(last, ["idx", "batch"]).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
