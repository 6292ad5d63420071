"""Top N items within every group, by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ledgerlens.runtime import broadcast_if_small, cut_lineage


def clean_score(score: Column) -> Column:
    """The score as a double, null where it is NaN."""
    value = score.cast("double")
    return F.when(~F.isnan(value), value)


def _local(narrow: DataFrame, groups: list[str], item: str, n: int) -> DataFrame:
    """The ``n`` best different items of each group in each task, with their ``place`` in the task from 1.

    The JVM sorts each task's rows, so they stream by, group after group; beyond a batch only the open group's best
    ``n`` are held.
    """
    schema = T.StructType([*narrow.schema.fields, T.StructField("place", T.IntegerType())])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_rows: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            old = 0 if open_rows is None else len(open_rows)
            rows = (batch if open_rows is None else pd.concat([open_rows, batch])).reset_index(drop=True)
            fresh = np.arange(len(rows)) >= old
            rows = rows.assign(fresh=fresh).drop_duplicates([*groups, item], keep="first")
            number = rows.groupby(groups, sort=False, dropna=False).ngroup().to_numpy()
            place = rows.groupby(groups, sort=False, dropna=False).cumcount().to_numpy()
            keep = place < n
            yield rows[keep & rows["fresh"].to_numpy()].drop(columns="fresh").assign(place=place[keep & rows["fresh"].to_numpy()] + 1)
            open_rows = rows[keep & (number == number[-1])].drop(columns="fresh")

    ordered = narrow.sortWithinPartitions(*groups, F.col("score").desc(), F.col(item))
    return ordered.mapInPandas(best, schema)


def top_n(df: DataFrame, groups: list[str], item: str, score: str, n: int = 3) -> DataFrame:
    """The ``n`` highest-scoring items of each group: ``groups``, ``item``, ``score`` and ``rank`` from 1.

    Every task finds, in its own partition, each group's N-th best score. N items reach it, so no item below it
    can be among the group's N best: a valid lower bound. Tasks hand on only the rows that reach their own
    bounds, at most N per group. The highest bound of every group that still has more than N rows is joined to
    them, before they are exchanged where the counted bounds are few enough to be broadcast; rows below it go, and
    the survivors are ranked. A group with a third of all rows thus sends N rows per task, never its bulk.

    Defined cases: null and NaN scores take no part; null items take no part; null group values form a group of
    their own; repeated rows of an item count once, with the item's highest score; equal scores are ordered by
    the lower item; an empty table gives an empty result; other columns are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    narrow = df.select(*groups, F.col(item), clean_score(F.col(score)).alias("score")).where(F.col("score").isNotNull() & F.col(item).isNotNull())
    local = cut_lineage(_local(narrow, groups, item, n))
    crowded = local.groupBy(*groups).agg(F.count("*").alias("__rows"), F.max(F.when(F.col("place") == n, F.col("score"))).alias("__bound"))
    bounds = cut_lineage(crowded.where((F.col("__rows") > n) & F.col("__bound").isNotNull()).drop("__rows"))
    bounded = local.join(broadcast_if_small(bounds, bounds.count()), groups, "left")
    survivors = bounded.where(F.col("__bound").isNull() | (F.col("score") >= F.col("__bound"))).select(*groups, item, "score")
    items = survivors.repartition(*groups).groupBy(*groups, item).agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy(*groups).orderBy(F.col("score").desc(), F.col(item)))
    return items.withColumn("rank", rank).where(F.col("rank") <= n)


def brute_top_n(rows: list[tuple], n: int) -> set[tuple]:
    """The plain version for tests: rows are (group, item, score); the result is (group, item, score)."""
    best: dict = {}
    for group, item, score in rows:
        if item is not None and score is not None and not np.isnan(score):
            own = best.setdefault(group, {})
            own[item] = max(score, own.get(item, -np.inf))
    return {(g, i, s) for g, own in best.items() for i, s in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:n]}
