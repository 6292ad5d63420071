"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.runtime import BROADCAST_ROWS, cut_lineage

#: A rank file of a public byte-level BPE tokenizer, read by the driver.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rounds of raking and of calibration at most, and the changes at which they end before.
ROUNDS, CALIBRATIONS = 2000, 12
STEADY, CLOSE = 1e-9, 1e-4
#: Margins besides the source: the column of the cells and its name in reports.
MARGINS = {"lang": "language", "topic": "topic"}


def source_key(source: Column) -> Column:
    """The source's name without differences of case and outer whitespace; null for an empty one."""
    return F.nullif(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), F.lit(""))


def language_key(lang: Column) -> Column:
    """The primary language subtag in lower case; ``und`` where there is none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]+)", 1)), F.lit("")), F.lit("und"))


def topic_key(title: Column) -> Column:
    """The kind of document that a title names after its year; ``other`` where there is none."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(title, r"\d{4}年?(.+)$", 1)), F.lit("")), F.lit("other"))


def token_sizes(docs: DataFrame, doc: str, text: str, keep: dict[str, Column], tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``tokens`` and the columns of ``keep``, one row per document; whole texts are tokenized, none is shuffled.

    The vocabulary is of fixed size and is broadcast, so executors need no file.
    """
    with open(tokenizer, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), *(c.alias(n) for n, c in keep.items()), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=held.value, special_tokens={})
        for batch in batches:
            yield batch.assign(tokens=[len(encoder.encode_ordinary(t)) for t in batch["text"]]).drop(columns="text")

    names = ["doc_id", *keep, "tokens"]
    counted = rows.mapInPandas(count, "doc_id long, " + ", ".join(f"{n} string" for n in keep) + ", tokens long")
    return counted.groupBy("doc_id").agg(F.max(F.struct("tokens", *keep)).alias("d")).select("doc_id", *(f"d.{n}" for n in names[1:]))


def _frequent(rows: DataFrame, name: str, most: int) -> list[str]:
    return [r[0] for r in rows.groupBy(name).agg(F.sum("tokens").alias("n")).orderBy(F.col("n").desc(), name).limit(most).collect()]


@dataclass
class Raking:
    """What raking came to: the weight of each cell, the rounds it took, the last round's largest change of a weight, and whether that is as good as none."""

    weight: np.ndarray
    rounds: int
    change: float

    @property
    def steady(self) -> bool:
        return self.change < STEADY


@dataclass
class Mixture:
    """A fitted mixture: the sized documents with their copies, the cells with their weights, the targets by margin, how raking ended, and the values that were folded."""

    documents: DataFrame
    cells: pd.DataFrame
    targets: pd.DataFrame
    total: float
    raking: Raking
    goals: dict[str, dict[str, float]]
    folded: dict[str, int] = field(default_factory=dict)


def own_shares(cells: pd.DataFrame, name: str) -> dict[str, float]:
    """The share of all tokens that each value of a margin has in the corpus."""
    sums = cells.groupby(name)["tokens"].sum()
    return (sums / max(1, sums.sum())).to_dict()


def rake(cells: pd.DataFrame, targets: pd.DataFrame, total: float, goals: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> Raking:
    """Expected uses of each cell's tokens: raked to the source shares of ``total`` and to the shares ``goals`` of languages and topics, by default those of the cells.

    Each round scales the cells of every language, topic and then source to that margin's tokens; no weight may
    exceed its source's cap, and a source whose cells reach it passes the rest to its other cells. The sources
    come last, so their shares hold exactly wherever the caps allow it; the other margins are met as far as
    they agree with the sources, and values without a goal go as the rest takes them.
    """
    goals = goals or {name: own_shares(cells, name) for name in MARGINS}
    size = cells["tokens"].to_numpy(dtype=float)
    cap = cells["source"].map(targets.set_index("source")["max_repeat"]).to_numpy(dtype=float)
    wanted = targets.set_index("source")["target_share"] * total
    weight, change, done = np.minimum(1.0, cap), np.inf, 0
    codes = {name: pd.factorize(cells[name]) for name in MARGINS}
    aim = {name: np.array([goals.get(name, {}).get(v, np.nan) for v in values]) * total for name, (_, values) in codes.items()}
    by_source = [(source, (cells["source"] == source).to_numpy() & (size > 0)) for source in cells["source"].unique()]
    while done < rounds and change >= STEADY:
        before, done = weight.copy(), done + 1
        for name in MARGINS:
            code, values = codes[name]
            now = np.bincount(code, weights=weight * size, minlength=len(values))
            with np.errstate(invalid="ignore", divide="ignore"):
                scale = np.where((now > 0) & ~np.isnan(aim[name]), aim[name] / now, 1.0)
            weight = np.minimum(weight * scale[code], cap)
        for source, own in by_source:
            goal, free = wanted[source], own.copy()
            while free.any():
                fixed = (weight * size)[own & ~free].sum()
                now = (weight * size)[free].sum()
                if now <= 0:
                    break
                weight[free] *= max(0.0, goal - fixed) / now
                over = free & (weight > cap)
                if not over.any():
                    break
                weight[over] = cap[over]
                free &= ~over
        change = float(np.abs(weight - before).max(initial=0.0))
    return Raking(weight, done, change if done else 0.0)


def mix(docs: DataFrame, targets: DataFrame, doc: str, text: str, source: str, lang: str, title: str, total: float | None = None, seed: int = 17, tokenizer: str = TOKENIZER, goals: dict[str, dict[str, float]] | None = None, values: int | None = None, rounds: int = ROUNDS) -> Mixture:
    """Choose how often each document is used so that every source has its target share of all tokens.

    ``total`` is the mixture's size in tokens; by default the largest at which every source that has documents
    can reach its share under its cap. Token weights per (source, language, topic) cell are raked to their
    margins: ``goals`` has target shares by value for ``lang`` and ``topic``, a margin not in it keeps the corpus's own
    shares. A document is used as often as its cell's weight says, the fraction decided by a hash of its id. The
    chance of that fraction is then calibrated per source against the tokens really drawn, since document
    lengths differ. The driver sees only the cells, which are counted first. Every value has a margin of its own;
    with ``values``, only the most frequent ones of each margin, and ``folded`` tells how many share the value ``other``.

    Defined cases: sources are compared without case and outer whitespace; documents of sources without
    target, with null source or without tokens are not used; targets without documents reach 0; repeated rows
    count once; repeated targets count once; an empty table gives an empty mixture; more cells than can be read to the
    driver are an error that asks for ``values``.
    """
    keep = {"source": source_key(F.col(source)), "lang": language_key(F.col(lang)), "topic": topic_key(F.col(title))}
    goal = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeat").cast("int").alias("max_repeat")).where("source is not null and target_share > 0 and max_repeat > 0")
    wanted = goal.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat")).orderBy("source").toPandas()
    sized = cut_lineage(token_sizes(docs, doc, text, keep, tokenizer))
    used, folded = sized.join(F.broadcast(goal.select("source").distinct()), "source", "left_semi").where("tokens > 0"), {}
    for name in MARGINS if values is not None else ():
        frequent = _frequent(used, name, values)
        folded[name] = max(0, used.select(name).distinct().count() - len(frequent))
        used = used.withColumn(name, F.when(F.col(name).isin(frequent), F.col(name)).otherwise("other"))
    grouped = cut_lineage(used.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")))
    if grouped.count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} cells of source, language and topic: set values")
    cells = grouped.orderBy("source", "lang", "topic").toPandas()
    have = cells.groupby("source")["tokens"].sum()
    present = wanted[wanted["source"].isin(have.index)]
    if total is None:
        total = float((present["max_repeat"] * present["source"].map(have) / present["target_share"]).min()) if len(present) else 0.0
    goals = {name: (goals or {}).get(name) or own_shares(cells, name) for name in MARGINS}
    raking = rake(cells, wanted, total, goals, rounds) if len(cells) else Raking(np.empty(0), 0, 0.0)
    cells["weight"] = raking.weight
    spark = docs.sparkSession
    if not len(cells):
        return Mixture(used.withColumn("copies", F.lit(0)).where("false"), cells, wanted, total, raking, goals, folded)
    table = spark.createDataFrame(cells[["source", "lang", "topic", "weight"]])
    chance = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("chance")
    drawn = cut_lineage(used.join(F.broadcast(table), ["source", "lang", "topic"]).select("doc_id", "source", "lang", "topic", "tokens", "weight", chance))
    factor = dict.fromkeys(have.index, 1.0)
    expected = cells.assign(t=cells["tokens"] * cells["weight"]).groupby("source")["t"].sum()
    best, gap = dict(factor), dict.fromkeys(have.index, np.inf)
    for _ in range(CALIBRATIONS):
        reached = {r["source"]: r["t"] for r in drawn.groupBy("source").agg(F.sum(F.col("tokens") * _copies(factor)).alias("t")).collect()}
        for s in factor:
            off = abs(reached.get(s, 0.0) - expected[s]) / max(1.0, expected[s])
            if off < gap[s]:
                best[s], gap[s] = factor[s], off
        if max(gap.values()) < CLOSE:
            break
        factor = {s: f * min(2.0, max(0.5, expected[s] / reached[s])) if reached.get(s) else f for s, f in factor.items()}
    cap = F.coalesce(_lookup(dict(zip(wanted["source"], wanted["max_repeat"].astype(float), strict=True))), F.lit(0.0))
    copies = F.least(_copies(best), cap).cast("int")
    return Mixture(drawn.withColumn("copies", copies).drop("weight", "chance"), cells, wanted, total, raking, goals, folded)


def _lookup(values: dict[str, float]) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, float(v))]
    return F.element_at(F.create_map(*pairs), F.col("source"))


def _copies(factor: dict[str, float]) -> Column:
    """Uses of a document: the whole part of its calibrated weight, and one more where its hash falls below the fraction."""
    calibrated = F.col("weight") * _lookup(factor)
    return F.floor(calibrated) + F.when(F.col("chance") < calibrated - F.floor(calibrated), 1.0).otherwise(0.0)


def documents(mixture: Mixture) -> DataFrame:
    """The documents of a mixture: ``doc_id``, ``source``, ``lang``, ``topic``, ``tokens``, ``copies``."""
    return mixture.documents.where("copies > 0")


def shares(mixture: Mixture) -> DataFrame:
    """The shares really reached, by margin (source, language, topic) and value.

    ``margin``, ``value``, ``target_share``, ``fitted_share`` (after raking), ``reached_share`` (of the documents drawn),
    ``residual`` (reached less target; null without target), ``tokens``, ``documents``, ``most_copies``, ``max_repeat``
    (of sources) and ``steady``, false where raking had not come to rest. One row per target and per value that has
    documents; a value may be in no goal.
    """
    spark = mixture.documents.sparkSession
    used, cells = documents(mixture), mixture.cells
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(c).alias("value")) for c, m in [("source", "source"), *MARGINS.items()]))).alias("m")
    sums = used.select(each, "tokens", "copies").groupBy("m.margin", "m.value").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    goals = {"source": mixture.targets.set_index("source")["target_share"].to_dict(), **mixture.goals}
    caps = mixture.targets.set_index("source")["max_repeat"].to_dict()
    fitted = cells["tokens"] * cells["weight"] if len(cells) else pd.Series(dtype=float)
    rows = []
    for column, margin in [("source", "source"), *MARGINS.items()]:
        own = fitted.groupby(cells[column]).sum() if len(cells) else pd.Series(dtype=float)
        for value in sorted({*goals.get(column, {}), *own.index}):
            goal = goals.get(column, {}).get(value)
            rows.append((margin, value, None if goal is None else float(goal), round(float(own.get(value, 0.0) / max(1.0, fitted.sum())), 6), int(caps[value]) if margin == "source" else None, mixture.raking.steady))
    wanted = spark.createDataFrame(rows, "margin string, value string, target_share double, fitted_share double, max_repeat int, steady boolean")
    everything = used.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    reached = F.round(F.coalesce("tokens", F.lit(0)) / F.lit(max(1, everything)), 6)
    told = wanted.join(sums, ["margin", "value"], "left").withColumn("reached_share", reached)
    return told.select("margin", "value", "target_share", "fitted_share", "reached_share", F.round(F.col("reached_share") - F.col("target_share"), 6).alias("residual"), zero("tokens"), zero("documents"), zero("most_copies"), "max_repeat", "steady")
