"""Near-duplicate records: a chosen-path set similarity join on minwise tokens, and the groups its links form."""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.runtime import HOT_ROWS, broadcast_if_small, cut_lineage, repeated, salted, spread_join

#: Minwise tokens per record on which paths branch, and minwise bits of its sketch.
TOKENS, SKETCH = 64, 128
#: Share of the pairs at the threshold that the trees together must bring into one node, for which plan() chooses branches and trees.
RECALL = 0.998
#: Least threshold for which TOKENS tokens give that many branches.
LEAST_THRESHOLD = 0.3
#: Records in a node that are compared exhaustively; larger nodes branch further.
NODE = 400
#: Records of one side when a node whose records agree in their tokens is compared block against block.
BLOCK = 4096
#: Large nodes branch on while a level leaves at most this share of their rows in large nodes; else their records agree.
SHRINKS = 0.7
#: Standard deviations by which the sketch of a pair at the threshold may fall short before the pair is left unverified.
SLACK = 3.3

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_COEFFICIENTS = np.random.default_rng(20240229).integers(0, 2**32, (2, SKETCH), dtype=np.uint32)
_WORD = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W\d_]+|\d+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int, unit: str) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes; a text shorter than a shingle is one shingle."""
    if unit == "char":
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    else:
        codes = np.array([int.from_bytes(w.encode()[:8].ljust(8, b"\0"), "little") ^ (hash_words(w) if len(w) > 2 else 0) for w in _WORD.findall(text.lower())], dtype=np.uint64)
    if not len(codes):
        return codes
    n = max(1, len(codes) - width + 1)
    h = np.full(n, min(len(codes), width), dtype=np.uint64)
    factor = 1
    for k in range(min(width, len(codes))):
        factor = factor * int(_M1) & 0xFFFFFFFFFFFFFFFF
        h += codes[k : k + n] * np.uint64(factor)
    return np.unique(_mix(h))


def hash_words(word: str) -> int:
    """A 64-bit hash of a word that is the same in every process."""
    h = 1469598103934665603
    for b in word.encode():
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The minwise values of a shingle set under SKETCH hash functions; a long text's shingles are taken part by part."""
    a, b = (_COEFFICIENTS[0] | np.uint32(1))[:, None], _COEFFICIENTS[1][:, None]
    short, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(SKETCH, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(short), 4096):
        under = a * short[None, at : at + 4096]
        under += b
        np.minimum(least, under.min(axis=1), out=least)
    return least


@dataclass(frozen=True)
class Plan:
    """Tokens chosen per node, independent trees, and sketch bits in which a candidate pair may differ."""

    branch: int
    trees: int
    apart: int


def plan(threshold: float, recall: float = RECALL) -> Plan:
    """Branches, trees and sketch limit for a threshold.

    With ``branch`` tokens chosen at a node, a pair of similarity j shares branch * j children on average: more than
    one keeps it together at any depth with a fixed probability, from which the number of trees follows.
    """
    branch = max(2, math.ceil(1.4 / threshold))
    stay = 1.0
    for _ in range(50):
        stay = 1 - (1 - threshold * stay) ** branch
    trees = max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - stay))))
    # Sketch bits of a pair of similarity j agree with probability (1 + j) / 2.
    apart = SKETCH * (1 - threshold) / 2 + SLACK * math.sqrt(SKETCH * (1 - threshold * threshold) / 4)
    return Plan(branch, trees, math.floor(apart))


def compared(text: str, unit: str) -> str:
    """The form in which a text is compared: without whitespace for characters, with single spaces and in lower case for words."""
    return "".join(text.split()) if unit == "char" else " ".join(text.lower().split())


def text_hash(text: str) -> tuple[int, int]:
    """A 128-bit hash as two numbers."""
    return struct.unpack("<qq", hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())


def _signatures(batch: pd.DataFrame, width: int, unit: str) -> pd.DataFrame:
    out = []
    for i, raw in zip(batch["id"], batch["text"], strict=True):
        text = compared(raw, unit)
        h = shingles(text, width, unit)
        if not len(h):
            continue
        m = minwise(h)
        bits = np.packbits((m >> np.uint32(9)) & np.uint32(1)).view(np.int64)
        out.append((i, *text_hash(text), int(bits[0]), int(bits[1]), m[:TOKENS].tobytes()))
    return pd.DataFrame(out, columns=["id", "h1", "h2", "s1", "s2", "tokens"])


def _branch(nodes: np.ndarray, tokens: np.ndarray, branch: int) -> np.ndarray:
    """The children of each record's nodes: ``nodes`` (records x m) and ``tokens`` (records x TOKENS) give records x (m * branch).

    A node's hash alone chooses the token places on which it branches, so all its records choose the same ones.
    """
    rows, places = np.arange(len(nodes))[:, None], TOKENS // branch
    out = []
    for k in range(branch):
        place = _mix(nodes + np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(places) + np.uint64(k * places)
        out.append(_mix(nodes * _M1 + (place << np.uint64(32)) + tokens[rows, place.astype(np.int64)].astype(np.uint64)))
    return np.concatenate(out, axis=1)


def _tokens(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(-1, TOKENS)


def _paths(signatures: DataFrame, depth: int, how: Plan) -> DataFrame:
    """Every record's nodes at ``depth`` of each tree: ``node``, ``key``, ``s1``, ``s2``. Nothing is shuffled: paths depend on the record alone."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in range(0, len(batch), 2000):
                rows = batch.iloc[part : part + 2000]
                tokens = _tokens(rows["tokens"])
                nodes = np.tile(_mix(np.arange(1, how.trees + 1, dtype=np.uint64) * _M1), (len(rows), 1))
                for _ in range(depth):
                    nodes = _branch(nodes, tokens, how.branch)
                repeat = nodes.shape[1]
                yield pd.DataFrame({"node": nodes.ravel().view(np.int64), **{c: np.repeat(rows[c].to_numpy(), repeat) for c in ("key", "s1", "s2")}})

    return signatures.select("key", "s1", "s2", "tokens").mapInPandas(walk, "node long, key long, s1 long, s2 long")


def _deeper(large: DataFrame, signatures: DataFrame, how: Plan) -> DataFrame:
    """The children of large nodes: rows (``node``, ``key``) become rows one level down."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes = _branch(batch["node"].to_numpy().view(np.uint64)[:, None], _tokens(batch["tokens"]), how.branch)
            yield pd.DataFrame({"node": nodes.ravel().view(np.int64), **{c: np.repeat(batch[c].to_numpy(), how.branch) for c in ("key", "s1", "s2")}})

    return large.join(signatures, "key").select("node", "key", "s1", "s2", "tokens").mapInPandas(walk, "node long, key long, s1 long, s2 long")


def _crowded(paths: DataFrame, rows: int, most: int = HOT_ROWS) -> DataFrame | None:
    """Nodes of more than ``most`` rows, ready to be joined; None where there is none.

    Rows are first counted per bucket of nodes, of which there are few, so that counting needs next to no shuffle;
    nodes are counted only in buckets that hold more than ``most`` rows.
    """
    if rows <= most:
        return None
    buckets = 1 << max(12, math.ceil(math.log2(64 * rows / most)))
    bucket = F.pmod("node", F.lit(buckets)).alias("bucket")
    full = cut_lineage(paths.groupBy(bucket).count().where(F.col("count") > most).select("bucket"))
    many = full.count()
    if not many:
        return None
    inside = paths.select("node", bucket).join(broadcast_if_small(full, many), "bucket", "left_semi")
    nodes = cut_lineage(inside.groupBy("node").count().where(F.col("count") > most).select("node"))
    many = nodes.count()
    return broadcast_if_small(nodes, many) if many else None


def _close(node: np.ndarray, ids: np.ndarray, s1: np.ndarray, s2: np.ndarray, most: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows in the same (contiguous) node whose sketches differ in at most ``most`` bits; with ``side``, only pairs across sides where a node has two (1 and 2; 0 is a node of one)."""
    left, right = [], []
    s1, s2 = s1.view(np.uint64), s2.view(np.uint64)  # bitwise_count takes the absolute value of signed integers
    at, k = np.arange(len(node) - 1), 1
    while len(at):
        at = at[node[at] == node[at + k]]
        apart = np.bitwise_count(s1[at] ^ s1[at + k]).astype(np.int64) + np.bitwise_count(s2[at] ^ s2[at + k])
        hit = at[apart <= most]
        if side is not None:
            hit = hit[(side[hit] == 0) | (side[hit] != side[hit + k])]
        left.append(ids[hit])
        right.append(ids[hit + k])
        k += 1
        at = at[at + k < len(node)]
    none = np.empty(0, dtype=np.int64)
    a, b = (np.concatenate(x) if x else none for x in (left, right))
    keep = a != b
    return np.minimum(a, b)[keep], np.maximum(a, b)[keep]


def _compare(paths: DataFrame, most: int, limit: int) -> DataFrame:
    """Nodes of up to ``limit`` records compared exhaustively; rows of larger nodes handed on.

    Result: ``a``, ``b`` of a close pair and null ``node``, or the row ``node``, ``a`` of a large node. A task
    reads its nodes in order and holds at most one node's ``limit`` rows beyond a batch; a larger node, of HOT_ROWS
    rows at most, passes through it row by row.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        passing: int | None = None

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            node = rows["node"].to_numpy()
            edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, dtype=np.int64)
            size = np.repeat(np.diff(np.r_[edge, len(node)]), np.diff(np.r_[edge, len(node)])) if len(node) else edge
            big = size > limit
            if passing is not None:
                big |= node == passing
            small = rows[~big]
            a, b = _close(*(small[c].to_numpy() for c in ("node", "key", "s1", "s2")), most)
            over = rows[big]
            return pd.DataFrame({"node": pd.array([None] * len(a) + over["node"].tolist(), dtype="Int64"), "a": np.r_[a, over["key"].to_numpy()], "b": pd.array(b.tolist() + [None] * len(over), dtype="Int64")})

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = rows["node"].iloc[-1] if len(rows) else None
            if last is None:
                continue
            tail = rows["node"].to_numpy() == last
            if passing == last or tail.sum() > limit:
                yield done(rows)
                held, passing = None, last
            else:
                yield done(rows[~tail])
                held, passing = rows[tail], None
        if held is not None:
            yield done(held)

    ordered = paths.repartition("node").sortWithinPartitions("node", "key")
    return ordered.mapInPandas(scan, "node long, a long, b long")


def _blocks(large: DataFrame, signatures: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """Close pairs of nodes whose records agree in their tokens, compared block against block so that no task holds a whole node."""
    sizes = cut_lineage(large.groupBy("node").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("parts")))
    rows = large.join(broadcast_if_small(sizes, sizes.count()), "node").join(signatures.select("key", "s1", "s2"), "key")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    rows = rows.select(F.xxhash64("node", low, high).alias("node"), "key", "s1", "s2", F.when(F.col("part") == F.col("other"), F.lit(0)).otherwise(F.when(F.col("part") < F.col("other"), 1).otherwise(2)).alias("side"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def done(r: pd.DataFrame) -> pd.DataFrame:
            a, b = _close(*(r[c].to_numpy() for c in ("node", "key", "s1", "s2")), most, r["side"].to_numpy())
            return pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            r = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(r):
                tail = r["node"].to_numpy() == r["node"].iloc[-1]
                yield done(r[~tail])
                held = r[tail]
        if held is not None:
            yield done(held)

    return rows.repartition("node").sortWithinPartitions("node", "key").mapInPandas(scan, "a long, b long")


def _depth(signatures: DataFrame, records: int, limit: int) -> int:
    """Levels after which an ordinary node has few records, from the measured chance that two records share a token.

    The chance is the sum of squared value shares at four token places, over all records.
    """
    places = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.substring("tokens", 4 * p + 1, 4).alias("v")) for p in (3, 17, 35, 53))))
    counted = signatures.select(places.alias("x")).groupBy("x.p", "x.v").count().groupBy("p").agg(F.sum(F.col("count") * (F.col("count") - 1)).alias("same"))
    rows = [r["same"] / max(1, records * (records - 1)) for r in counted.collect()]
    chance = min(0.5, max(1e-6, float(np.median(rows)) if rows else 1e-6))
    return max(1, math.ceil(math.log(max(1.0, records / limit)) / -math.log(chance)))


def _texts(df: DataFrame, record: str, text: str) -> DataFrame:
    return df.select(F.col(record).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.char_length("text") > 0))


class NearDuplicates:
    """The similarity join over one collection; its parts are made once and shared by links(), pairs() and groups().

    Equal texts are first reduced to one class, combining on the map side, so a third of all rows being copies
    costs one class. Classes get TOKENS minwise tokens and a SKETCH-bit sketch. In each independent tree a class
    follows a few tokens per level, chosen by the node; classes that choose the same tokens with the same values meet
    in a node. Small nodes are compared exhaustively by sketch, large ones branch further; nodes of more than
    HOT_ROWS rows do so without being gathered. Where branching no longer makes nodes smaller, their records agree in
    their tokens, hence are similar to one another, and each is compared with all of its node, in blocks. Every
    close pair is then verified exactly on the texts' shingle sets. Branches, trees and the sketch's limit follow from
    the threshold, see plan().

    Defined cases: records with null or empty text, or without id, have no links; repeated rows count once; each of
    several texts of one id is compared, and the id has the links of all; a text shorter than a shingle is one
    shingle; an empty table gives empty results; other columns are ignored.
    """

    def __init__(self, df: DataFrame, record: str, text: str, threshold: float = 0.8, width: int = 5, unit: str = "word", trees: int | None = None, limit: int = NODE, hot_rows: int = HOT_ROWS, block: int = BLOCK) -> None:
        if unit not in ("char", "word") or not LEAST_THRESHOLD <= threshold <= 1:
            raise ValueError(f"unit is char or word; threshold lies in [{LEAST_THRESHOLD}, 1]")
        self.df, self.record, self.text, self.threshold, self.width, self.unit, self.limit, self.hot_rows, self.block = df, record, text, threshold, width, unit, limit, hot_rows, block
        how = plan(threshold)
        self.plan = how if trees is None else Plan(how.branch, trees, how.apart)
        self._links: DataFrame | None = None
        self._members: DataFrame | None = None
        self._classes: DataFrame | None = None
        self._signed: DataFrame | None = None
        self._hot: DataFrame | None = None

    def classes(self) -> DataFrame:
        """One row per different text: ``key``, the 128-bit hash ``h1``, ``h2``, ``rep`` (the lowest id), its ``rows``, the sketch ``s1``, ``s2`` and ``tokens``."""
        if self._classes is None:
            width, unit = self.width, self.unit

            def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for part in range(0, len(batch), 1000):
                        yield _signatures(batch.iloc[part : part + 1000], width, unit)

            rows = _texts(self.df, self.record, self.text)
            self._signed = cut_lineage(rows.mapInPandas(sign, "id long, h1 long, h2 long, s1 long, s2 long, tokens binary"))
            own = self._signed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("s1", "s2", "tokens")))
            self._classes = cut_lineage(own.withColumn("key", F.monotonically_increasing_id()))
            hot = self._classes.where(F.col("rows") > self.hot_rows).select("h1", "h2", "key", F.ceil(F.col("rows") / F.lit(self.hot_rows)).cast("int").alias("__parts"))
            many = hot.count()
            self._hot = broadcast_if_small(hot, many) if many else None
        return self._classes

    def _hot_by(self, *on: str) -> DataFrame | None:
        self.classes()
        return self._hot.select(*on, "__parts") if self._hot is not None else None

    def _of_members(self, stats: DataFrame, how: str = "inner") -> DataFrame:
        """``stats`` by ``key`` joined to the members; a class of many copies is spread."""
        hot = self._hot_by("key")
        return salted(self.members(), hot, ["key"], "id").join(repeated(stats, hot, ["key"]), ["key", "__salt"], how).drop("__salt")

    def members(self) -> DataFrame:
        """``id``, ``key`` and ``rep``: the class of each record, or the classes where a record has several texts, and the class's lowest id."""
        if self._members is None:
            known, hot = self.classes().select("h1", "h2", "key", "rep"), self._hot_by("h1", "h2")
            own = salted(self._signed.select("id", "h1", "h2"), hot, ["h1", "h2"], "id")
            self._members = cut_lineage(own.join(repeated(known, hot, ["h1", "h2"]), ["h1", "h2", "__salt"]).select("id", "key", "rep").distinct())
        return self._members

    def candidates(self) -> DataFrame:
        """Close pairs of classes by sketch: ``a`` < ``b``, by key."""
        signatures = self.classes().select("key", "s1", "s2", "tokens")
        records = signatures.count()
        depth = _depth(signatures, records, self.limit)
        found, before = [], None
        paths, rows = _paths(signatures, depth, self.plan), records * self.plan.trees * self.plan.branch**depth
        while True:
            crowded = _crowded(paths, rows, self.hot_rows)
            calm = paths if crowded is None else paths.join(crowded, "node", "left_anti")
            scanned = cut_lineage(_compare(calm, self.plan.apart, self.limit))
            found.append(scanned.where("node is null").select("a", "b"))
            large = scanned.where("node is not null").select("node", F.col("a").alias("key"))
            if crowded is not None:
                large = cut_lineage(large.union(paths.join(crowded, "node", "left_semi").select("node", "key")))
            left = large.count()
            if not left:
                break
            if before is not None and left > SHRINKS * before:
                found.append(_blocks(large, signatures, self.plan.apart, self.block))
                break
            before, rows = left, left * self.plan.branch
            paths = _deeper(large, signatures, self.plan)
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        return every.distinct()

    def _named(self, ids: DataFrame) -> DataFrame:
        """``id``, ``h1``, ``h2`` and the compared ``text`` of the rows whose id is in ``ids``."""
        unit = self.unit

        def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = [compared(t, unit) for t in batch["text"]]
                yield pd.DataFrame([(i, *text_hash(t), t) for i, t in zip(batch["id"], texts, strict=True)], columns=["id", "h1", "h2", "text"])

        rows = _texts(self.df, self.record, self.text).join(ids, "id", "left_semi")
        return rows.mapInPandas(name, "id long, h1 long, h2 long, text string")

    def links(self) -> DataFrame:
        """Verified pairs of classes: keys ``a`` < ``b`` and their exact ``similarity``, at least the threshold."""
        if self._links is None:
            pairs = cut_lineage(self.candidates())
            n = pairs.count()
            involved = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
            wanted = self.classes().select("key", "h1", "h2", F.col("rep").alias("id")).join(broadcast_if_small(involved, 2 * n), "key", "left_semi")
            texts = self._named(broadcast_if_small(wanted.select("id").distinct(), 2 * n)).join(broadcast_if_small(wanted, 2 * n), ["id", "h1", "h2"])
            texts = texts.groupBy("key").agg(F.first("text").alias("text"))
            both = pairs
            for side, other in ("a", "b"), ("b", "a"):
                own = texts.withColumnsRenamed({"key": side, "text": f"t{side}"})
                both = spread_join(both, own, [side], other, most=self.hot_rows) if n > self.hot_rows else both.join(own, side)
            width, unit, threshold = self.width, self.unit, self.threshold

            def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    out = [(a, b, jaccard(x, y, width, unit)) for a, b, x, y in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True)]
                    yield pd.DataFrame([r for r in out if r[2] >= threshold], columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

            self._links = cut_lineage(both.select("a", "b", "ta", "tb").mapInPandas(verify, "a long, b long, similarity double"))
        return self._links

    def pairs(self) -> DataFrame:
        """All similar pairs of records, copies expanded: ``id_a`` < ``id_b``. Its size is that of the result asked for; a class of many copies is paired in blocks."""
        members = self.members().select("id", "key")
        left = self._of_members(self.links().select(F.col("a").alias("key"), "b")).select(F.col("id").alias("x"), F.col("b").alias("key"))
        across = self._of_members(left).select("x", F.col("id").alias("y"))
        copies = members.join(self.classes().where("rows > 1").select("key"), "key", "left_semi")
        equal = spread_join(copies.withColumnRenamed("id", "x"), copies.withColumnRenamed("id", "y"), ["key"], "x", most=self.block).select("x", "y")
        both = across.union(equal).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        return both.distinct()

    def groups(self) -> DataFrame:
        """One row per record with text: ``id``, ``rep`` (lowest id with an equal text), ``group`` (lowest id of its connected group), ``links`` of its classes to other classes.

        Texts of one id count as connected.
        """
        links = self.links().select("a", "b")
        degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
        several = self.members().groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z")
        versions = spread_join(self.members(), several, ["id"], "key", most=self.hot_rows).select("a", F.col("key").alias("b"))
        label = components(links.union(versions), hot_rows=self.hot_rows)
        own = self.classes().select("key", "rep").join(label.withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left")
        own = own.select("key", "rep", F.coalesce("label", "key").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
        lowest = own.groupBy("label").agg(F.min("rep").alias("group"))
        known = spread_join(own, lowest, ["label"], "key", most=self.hot_rows).select("key", "group", "links")
        return self._of_members(known).groupBy("id").agg(F.min("rep").alias("rep"), F.min("group").alias("group"), F.sum("links").alias("links"))


def jaccard(a: str, b: str, width: int, unit: str) -> float:
    """Exact similarity of two compared texts: shared over all different shingles, as strings."""
    x, y = shingle_set(a, width, unit), shingle_set(b, width, unit)
    return len(x & y) / len(x | y) if x or y else 0.0


def shingle_set(text: str, width: int, unit: str) -> set:
    """The different shingles of a compared text."""
    parts = text if unit == "char" else tuple(_WORD.findall(text.lower()))
    if not parts:
        return set()
    return {parts[i : i + width] for i in range(max(1, len(parts) - width + 1))}


def components(links: DataFrame, left: str = "a", right: str = "b", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Connected components of links: ``node`` and ``label``, the lowest node of its component.

    Alternating large-star and small-star steps, each a shuffle with map-side minima; the edges shrink towards
    stars in a number of rounds that grows with the logarithm of the component size. Nothing is collected, and a hub
    with more than ``hot_rows`` edges is spread over several tasks.
    """

    def with_least(rows: DataFrame) -> DataFrame:
        least = rows.groupBy("u").agg(F.min("v").alias("m"))
        return spread_join(rows, least, ["u"], "v", most=hot_rows)

    edges = cut_lineage(links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = with_least(large)
        after = cut_lineage(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
