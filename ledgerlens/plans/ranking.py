"""Ranks and running totals over rows spread by range over the whole cluster, so that no group or total meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.runtime import broadcast_if_small, cut_lineage


def _placed(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    ordered = df.repartitionByRange(*(F.col(k) for k in keys), *order).sortWithinPartitions(*(F.col(k) for k in keys), *order)
    at = ordered.withColumn("__at", F.monotonically_increasing_id())
    return cut_lineage(at.withColumn("__task", F.shiftright("__at", 33)))


def rank_all(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's place, from 1, in its group by ``order``, which must be total.

    The rows are sorted once by range, so a large group spans many tasks; a row's rank is its place within its
    task plus the rows of its group in earlier tasks.
    """
    placed = _placed(df, [group], order)
    parts = placed.groupBy(group, "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(group).orderBy("__task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col(group).alias("__group"), F.col("__task").alias("__part"), "__first", before.alias("__before"))
    joined = placed.join(parts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__task") == F.col("__part")))
    return joined.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first") + 1).drop("__at", "__task", "__group", "__part", "__first", "__before")


def number_all(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``df`` with each row's place, from 0, in the total order ``order``."""
    placed = _placed(df, [], order)
    parts = placed.groupBy("__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # One row per task: the only global window is over those.
    before = F.coalesce(F.sum("__n").over(W.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = F.broadcast(parts.select("__task", "__first", before.alias("__before")))
    return placed.join(parts, "__task").withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__task", "__first", "__before")


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each row in the total order ``order``."""
    placed = _placed(df, [], order)
    local = F.coalesce(F.sum(value).over(W.partitionBy("__task").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy("__task").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = F.broadcast(parts.select("__task", before.alias("__before")))
    return placed.withColumn("__local", local).join(parts, "__task").withColumn(name, F.col("__before") + F.col("__local")).drop("__at", "__task", "__local", "__before")


def group_quantiles(df: DataFrame, keys: list[str], value: str, spread_by: str, shares: list[float], from_top: tuple[int, ...] = ()) -> DataFrame:
    """``keys``, ``share_no`` and ``value``: of each group the value at rank max(1, ceil(share * n)), for every share, and then the k-th highest (the lowest, if there are fewer), for every k of ``from_top``.

    Exact at any size: the rows are sorted by range once, so a large group, or a large run of equal values, spans many
    tasks (``spread_by`` breaks ties between values); counts per task tell which row of which task is wanted.
    """
    placed = _placed(df.select(*keys, value, F.xxhash64(spread_by).alias("__tie")), keys, [F.col(value), F.col("__tie")])
    parts = placed.groupBy(*keys, "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    own = W.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(own.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("__before", before).withColumn("__total", F.sum("__n").over(own))
    places = [F.ceil(F.lit(float(s)) * F.col("__total")).cast("long") for s in shares] + [F.col("__total") - (k - 1) for k in from_top]
    share = F.explode(F.array(*(F.struct(F.lit(no).alias("no"), F.greatest(F.lit(1).cast("long"), p).alias("rank")) for no, p in enumerate(places)))).alias("s")
    wanted = parts.select("__first", "__n", "__before", "__total", share).withColumn("__rank", F.col("s.rank")).where("__rank > __before and __rank <= __before + __n")
    wanted = cut_lineage(wanted.select(F.col("s.no").alias("share_no"), (F.col("__first") + F.col("__rank") - F.col("__before") - 1).alias("__at")))
    return placed.join(broadcast_if_small(wanted, wanted.count()), "__at").select(*keys, "share_no", value)
