"""Which texts contain which phrases, without comparing every text with every phrase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import squeeze
from ledgerlens.runtime import broadcast_if_small, cut_lineage


def contained(patterns: DataFrame, texts: DataFrame, pattern_key: str, pattern: str, text_key: str, text: str, squeezed: bool = True) -> DataFrame:
    """``pattern_key``, ``text_key`` of every text that contains one of the key's patterns; with ``squeezed`` whitespace doesn't count.

    Patterns are taken by length, from one power of two to the next. Those of 2^k characters or more hold every
    gram of 2^(k-1) characters at one of any 2^(k-1) + 1 neighbouring places, so a text is looked up only by its
    grams at every (2^(k-1) + 1)-th place: an equality join of few grams. Candidates are then compared exactly.

    Defined cases: empty patterns and null texts match nothing; a key may have several patterns, of which one is enough;
    repeated rows count once.
    """
    clean = (lambda c: squeeze(F.col(c))) if squeezed else F.col
    wanted = patterns.select(F.col(pattern_key).alias("__k"), clean(pattern).alias("__p")).where(F.col("__k").isNotNull() & (F.char_length("__p") > 0)).distinct()
    wanted = cut_lineage(wanted.withColumn("__level", F.floor(F.log2(F.char_length("__p") + 0.5)).cast("int")))
    held = texts.select(F.col(text_key).alias("__t"), clean(text).alias("__x")).where(F.col("__t").isNotNull() & (F.char_length("__x") > 0))
    found = None
    # There are at most as many levels as bits in a length.
    for level in sorted(r[0] for r in wanted.select("__level").distinct().collect()):
        width = max(1, 1 << level >> 1)
        step = (1 << level) - width + 1
        own = wanted.where(F.col("__level") == level)
        grams = own.select("__p", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("__p") - width + 1), lambda i: F.substr("__p", i, F.lit(width))))).alias("__g"))
        # One match takes a gram and skips to the next place.
        probes = F.regexp_extract_all("__x", F.lit(f"([\\s\\S]{{{width}}})[\\s\\S]{{0,{step - width}}}"), F.lit(1))
        marked = held.select("__t", F.xxhash64("__x").alias("__h"), F.explode(F.array_distinct(probes)).alias("__g"))
        met = marked.join(broadcast_if_small(grams, grams.count()), "__g").select("__t", "__h", "__p")
        found = met if found is None else found.union(met)
    if found is None:
        return texts.sparkSession.createDataFrame([], T.StructType([patterns.schema[pattern_key], texts.schema[text_key]]))
    pairs = cut_lineage(found.distinct())
    there = held.withColumn("__h", F.xxhash64("__x")).join(broadcast_if_small(pairs, pairs.count()), ["__t", "__h"]).where(F.contains("__x", "__p"))
    return there.join(wanted.select("__k", "__p"), "__p").select(F.col("__k").alias(pattern_key), F.col("__t").alias(text_key)).distinct()
