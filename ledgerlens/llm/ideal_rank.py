"""One ranking from several differently scaled scores, by distance to an ideal and an anti-ideal point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.llm.topn import clean_score
from ledgerlens.plans.ranking import group_quantiles, rank_all
from ledgerlens.runtime import HOT_ROWS, cut_lineage, hot_keys, repeated, salted

#: Share of a group's values that is pulled in at either end before the scores are normalised.
TAIL = 0.02


def closeness(df: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None, tail: float = TAIL, hot_rows: int = HOT_ROWS, top: int | None = None) -> DataFrame:
    """Relative closeness of each item to its group's ideal point: ``group``, ``item``, the scores, ``closeness``.

    With ``top``, also the group's ``top``-th best value of each score as ``__top_<score>``, from the sort that finds the limits.

    Within a group each score is winsorised at its values of rank ceil(tail * n) and ceil((1 - tail) * n), exact for
    groups of any size, and divided by the Euclidean norm of the group's winsorised values, after a shift that puts
    the group's lowest value at zero, so that neither range nor sign of a scale matters. The ideal point has the best
    value of each score, the anti-ideal the worst; closeness is d- / (d+ + d-), with weighted distances, to nine
    decimals. An item that is at least as good as another in every score never gets a lower closeness.

    Limits come from one range sort of all values, norms and extremes from an aggregation that combines within tasks.
    The rows are partitioned by group once; a group of more than ``hot_rows`` rows is spread over as many parts as
    its count asks for, and only the one row per group travels to them.

    Defined cases: null and NaN scores count as the group's worst value of that score; a score that is the same
    (or missing) for the whole group contributes nothing; a group in which no score tells items apart has
    closeness 0.5; repeated rows count once, with their highest values; null groups and items take no part.
    """
    weights = weights or [1.0] * len(scores)
    total = sum(weights)
    if len(weights) != len(scores) or total <= 0 or min(weights) < 0:
        raise ValueError("one non-negative weight per score is needed, not all zero")
    clean = df.select(group, item, *(clean_score(F.col(s)).alias(s) for s in scores)).where(F.col(group).isNotNull() & F.col(item).isNotNull())
    hot = hot_keys(clean, [group], hot_rows)
    spread = salted(clean, hot, [group], item).repartition(group, "__salt")
    items = cut_lineage(spread.groupBy(group, "__salt", item).agg(*(F.max(s).alias(s) for s in scores)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("which"), F.col(s).alias("value")) for k, s in enumerate(scores)))).alias("x")
    long = items.select(group, item, each).select(group, item, "x.which", "x.value").where("value is not null")
    ends = ["lo", "hi", *(["top"] if top else [])]
    found = group_quantiles(long, [group, "which"], "value", item, [tail, 1 - tail], (top,) if top else ())
    at = lambda k, end: F.max(F.when((F.col("which") == k) & (F.col("share_no") == end), F.col("value")))
    limits = found.groupBy(group).agg(*(at(k, end).alias(f"__{name}_{s}") for k, s in enumerate(scores) for end, name in enumerate(ends)))
    cut = items.join(repeated(limits, hot, [group]), [group, "__salt"], "left")

    def winsorised(s: str) -> Column:
        low, high = F.col(f"__lo_{s}"), F.col(f"__hi_{s}")
        return F.coalesce(F.least(F.greatest(F.col(s), low), high) - low, F.lit(0.0))

    tops = [f"__top_{s}" for s in scores] if top else []
    cut = cut.select(group, "__salt", item, *scores, *tops, *(winsorised(s).alias(f"__w_{s}") for s in scores))
    norms = cut.groupBy(group).agg(*(F.sqrt(F.sum(F.col(f"__w_{s}") * F.col(f"__w_{s}"))).alias(f"__n_{s}") for s in scores), *(F.max(f"__w_{s}").alias(f"__m_{s}") for s in scores))
    both = cut.join(repeated(norms, hot, [group]), [group, "__salt"])

    def distance(s: str, weight: float, ideal: bool) -> Column:
        here = F.col(f"__m_{s}") - F.col(f"__w_{s}") if ideal else F.col(f"__w_{s}")
        scaled = F.when(F.col(f"__n_{s}") > 0, here / F.col(f"__n_{s}")).otherwise(0.0) * F.lit(weight / total)
        return scaled * scaled

    up = F.sqrt(sum((distance(s, w, True) for s, w in zip(scores, weights, strict=True)), F.lit(0.0)))
    down = F.sqrt(sum((distance(s, w, False) for s, w in zip(scores, weights, strict=True)), F.lit(0.0)))
    near = F.when(up + down > 0, down / (up + down)).otherwise(0.5)
    return both.select(group, item, *scores, *tops, F.round(near, 9).alias("closeness"))


def ideal_rank(df: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None, tail: float = TAIL) -> DataFrame:
    """One joint ranking per group: ``group``, ``item``, ``closeness``, ``rank``; ties go to the lower item. See closeness()."""
    return rank_all(closeness(df, group, item, scores, weights, tail).select(group, item, "closeness"), group, [F.col("closeness").desc(), F.col(item)])


def leaders(df: DataFrame, group: str, item: str, scores: list[str], n: int = 3, tail: float = TAIL) -> DataFrame:
    """Items that are among the ``n`` best of their group in every score: ``group``, ``item``.

    Such an item is beaten in a score by at most n - 1 items, hence has at most len(scores) * (n - 1) items that
    it doesn't equal or exceed in all scores; closeness never ranks an equalled or exceeded item above it. So
    the candidates are the head of the joint ranking, len(scores) * (n - 1) + 1 places with ties, whatever the size of
    the group. Each is then checked exactly against every score's n-th best value, which comes from the ranking's own sort.
    Tasks cut each group to its head before anything is exchanged.
    """
    near = cut_lineage(closeness(df, group, item, scores, None, tail, top=n))
    depth = len(scores) * (n - 1) + 1
    place = F.row_number().over(W.partitionBy(group).orderBy(F.col("closeness").desc(), F.col(item)))
    last = near.select(group, item, "closeness").withColumn("place", place).where(F.col("place") <= depth).groupBy(group).agg(F.min("closeness").alias("__last"))
    hot = hot_keys(near, [group])
    head = salted(near, hot, [group], item).join(repeated(last, hot, [group]), [group, "__salt"]).where(F.col("closeness") >= F.col("__last") - 2e-9)
    for s in scores:
        head = head.where(F.col(s) >= F.col(f"__top_{s}"))
    return head.select(group, item)
