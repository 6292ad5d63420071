"""Evaluation texts in training text, found with generalised suffix automata of the test items."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.near_dup import _M1, _mix
from ledgerlens.runtime import HOT_ROWS, cut_lineage, hot_keys, repeated, salted

#: Characters of test items that one automaton holds, hence what is read to the driver or broadcast at most; about 50 MB.
AUTOMATON_CHARS = 100_000
#: Bits of the table that tells texts without any gram of the items; 8 MB.
TABLE_BITS = 1 << 26
_DROP = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """Letters and digits only, after NFKC and lower-casing."""
    return _DROP.sub("", unicodedata.normalize("NFKC", text).lower())


class SuffixAutomaton:
    """All substrings of several strings, with the strings that hold each.

    States form a tree by their suffix links; the strings that hold a state's substrings are those with a prefix in
    its subtree. These are kept in the order of the tree, so a state's are a slice; memory is proportional to the
    characters, however many strings there are.
    """

    def __init__(self, texts: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for text in texts:
            last = 0
            for c in text:
                last = self._extend(last, c)
        size = len(self.next)
        self.count, total, own, seen = [0] * size, [0] * size, [0] * size, [-1] * size
        ends: list[tuple[int, int]] = []
        for number, text in enumerate(texts):
            at = 0
            for c in text:
                at = up = self.next[at][c]
                ends.append((at, number))
                own[at] += 1
                while up > 0 and seen[up] != number:
                    seen[up] = number
                    self.count[up] += 1
                    up = self.link[up]
        order = sorted(range(1, size), key=self.length.__getitem__)
        total = own[:]
        for at in reversed(order):
            total[self.link[at]] += total[at]
        start, free = [0] * size, [0] * size
        for at in order:
            parent = self.link[at]
            start[at] = free[parent]
            free[parent] += total[at]
            free[at] = start[at] + own[at]
        place, held = start[:], np.empty(len(ends), dtype=np.int32)
        for at, number in ends:
            held[place[at]] = number
            place[at] += 1
        self.start, self.total, self.held = start, total, held

    def items(self, at: int) -> list[int]:
        """The numbers of the strings that hold the substrings of state ``at``."""
        return np.unique(self.held[self.start[at] : self.start[at] + self.total[at]]).tolist()

    def _state(self, length: int, link: int, following: dict[str, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.next) - 1

    def _split(self, parent: int, c: str, child: int) -> int:
        copy = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(c) == child:
            self.next[parent][c] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, c: str) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, c, known)
        fresh = self._state(self.length[last] + 1, 0, {})
        parent = last
        while parent >= 0 and c not in self.next[parent]:
            self.next[parent][c] = fresh
            parent = self.link[parent]
        if parent >= 0:
            child = self.next[parent][c]
            self.link[fresh] = child if self.length[child] == self.length[parent] + 1 else self._split(parent, c, child)
        return fresh

    def grams(self, width: int) -> set[str]:
        """All substrings of ``width`` characters."""
        found, level = set(), [(0, "")]
        for _ in range(width):
            level = [(to, path + c) for at, path in level for c, to in self.next[at].items()]
        found.update(path for _, path in level)
        return found


class LeakFinder:
    """Streams a text through the automaton of the items and reports the spans of at least ``least`` characters shared with one."""

    def __init__(self, items: list[tuple[int, str]], least: int = 40) -> None:
        kept = [(i, normal(t)) for i, t in items if i is not None and t]
        kept = [(i, t) for i, t in kept if len(t) >= least]
        self.least, self.width = least, gram_width(least)
        self.ids = [i for i, _ in kept]
        self.automaton = SuffixAutomaton([t for _, t in kept])
        self.grams = self.automaton.grams(self.width) if kept else set()
        # For each state the one on its chain of suffixes that holds the suffix of ``least`` characters: its items are all that share that much here.
        length, link = self.automaton.length, self.automaton.link
        self._top = list(range(len(length)))
        for at in sorted(range(1, len(length)), key=length.__getitem__):
            if length[link[at]] >= least:
                self._top[at] = self._top[link[at]]

    def _ending(self, at: int, matched: int, end: int) -> Iterator[tuple[int, int, list[int]]]:
        """The matches that end at ``end``, from the longest down, each with the items that no longer one has."""
        seen: set[int] = set()
        while matched >= self.least:
            if self.automaton.count[at] > len(seen):
                new = [k for k in self.automaton.items(at) if k not in seen]
                yield end - matched, end, [self.ids[k] for k in new]
                seen.update(new)
            at = self.automaton.link[at]
            matched = self.automaton.length[at]

    def spans(self, text: str) -> Iterator[tuple[int, int, list[int]]]:
        """(start, end, item ids) in the normalised ``text`` of matches of at least ``least`` characters, the longest of each item among them.

        A match of ``least`` characters holds a whole gram that starts at a multiple of least - width + 1, so only
        grams at those places are looked up; where one occurs in an item, the automaton runs from the earliest
        start of such a match on, tracking the longest match that ends at each character, until it is past the gram
        and shorter than a gram: then every match that holds a gram seen so far has ended. Matches are reported where
        fewer items go on than hold the last ``least`` characters.
        """
        width, step, n, grams = self.width, self.least - self.width + 1, len(text), self.grams
        following, link, length, count, top = self.automaton.next, self.automaton.link, self.automaton.length, self.automaton.count, self._top
        done = 0
        for probe in range(0, n - width + 1, step):
            if probe + width <= done or text[probe : probe + width] not in grams:
                continue
            at, matched, i = 0, 0, max(probe - step + 1, 0)
            while i < n:
                c = text[i]
                while at and c not in following[at]:
                    at = link[at]
                    matched = length[at]
                if c in following[at]:
                    at = following[at][c]
                    matched += 1
                i += 1
                if matched >= self.least:
                    after = following[at].get(text[i]) if i < n else None
                    if after is None or not count[after] == count[at] == count[top[at]]:
                        yield from self._ending(at, matched, i)
                if i - matched > probe and matched < width:
                    break
            done = i


def gram_width(least: int) -> int:
    """Characters of the grams by which texts are looked up for matches of ``least`` characters."""
    return max(1, min(12, least // 3))


def gram_hashes(plain: str, width: int, step: int) -> np.ndarray:
    """64-bit hashes of the grams of a text that start at multiples of ``step``."""
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    at = np.arange(0, len(codes) - width + 1, step)
    h = np.full(len(at), width, dtype=np.uint64)
    for k in range(width):
        h = _mix((h + codes[at + k]) * _M1)
    return h.view(np.int64)


def _items(eval_items: DataFrame, item: str, expected: str, least: int) -> tuple[DataFrame, int]:
    """The different items that can match, ``item_id`` and normalised ``plain``, and their characters altogether."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plain = batch["plain"].map(normal)
            yield batch.assign(plain=plain)[plain.str.len() >= least]

    rows = eval_items.select(F.col(item).cast("long").alias("item_id"), F.col(expected).alias("plain")).where("item_id is not null and plain <> ''")
    kept = cut_lineage(rows.mapInPandas(fold, "item_id long, plain string").distinct())
    return kept, kept.agg(F.coalesce(F.sum(F.char_length("plain")), F.lit(0))).first()[0]


def _texts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.char_length("text") > 0))


def _collected(items: DataFrame, least: int) -> LeakFinder:
    """The finder of items of AUTOMATON_CHARS characters at most."""
    return LeakFinder([tuple(r) for r in items.orderBy("item_id", "plain").collect()], least)


def _spans_in_parts(texts: DataFrame, items: DataFrame, parts: int, least: int, hot_rows: int, table_bits: int = TABLE_BITS) -> DataFrame:
    """``doc_id``, ``h``, ``start``, ``end``, ``item_id`` of the matches with items that are too many for one automaton.

    Items are divided among ``parts`` automata, each made in the tasks that need it. A text meets an automaton only if
    one of its grams at every (least - width + 1)-th place occurs in an item of it: every match holds such a gram. Grams
    are compared by their hashes in a join, after a bit table of fixed size has kept most texts' grams from being
    shuffled. In each task items come first, then the texts, one after the other; neither are held as a group.
    """
    spark, width = texts.sparkSession, gram_width(least)
    step = least - width + 1
    items = cut_lineage(items.withColumn("part", F.pmod(F.xxhash64("item_id", "plain"), F.lit(parts)).cast("int")))

    def item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, plain in zip(batch["part"], batch["plain"], strict=True):
                yield pd.DataFrame({"gram": np.unique(gram_hashes(plain, width, 1)), "part": np.int32(part)})

    grams = cut_lineage(items.mapInPandas(item_grams, "gram long, part int").distinct())
    slot = F.pmod("gram", F.lit(table_bits))
    slots = grams.select(slot.alias("slot")).distinct()
    table = np.zeros(table_bits // 64, dtype=np.uint64)
    for r in slots.groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toLocalIterator():
        table[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    held = spark.sparkContext.broadcast(table)

    def text_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value
        for batch in batches:
            for d, h, t in zip(batch["doc_id"], batch["h"], batch["text"], strict=True):
                own = gram_hashes(normal(t), width, step)
                place = own % np.int64(table_bits)
                hit = np.unique(own[(bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1])
                if len(hit):
                    yield pd.DataFrame({"doc_id": d, "h": h, "gram": hit})

    named = texts.withColumn("h", F.xxhash64("text"))
    meets = named.select("doc_id", "h", "text").mapInPandas(text_grams, "doc_id long, h long, gram long").join(grams, "gram").select("doc_id", "h", "part").distinct()
    meets = cut_lineage(meets)
    hot = hot_keys(meets, ["part"], hot_rows)
    some = named.dropDuplicates(["doc_id", "h"]).join(salted(meets, hot, ["part"], "doc_id"), ["doc_id", "h"])
    rows = repeated(items, hot, ["part"]).select("part", "__salt", F.lit(0).alias("kind"), F.col("item_id").alias("id"), F.lit(0).cast("long").alias("h"), F.col("plain").alias("text"))
    rows = rows.union(some.select("part", "__salt", F.lit(1), "doc_id", "h", "text"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, own, finder = None, [], None
        for batch in batches:
            out = []
            for part, salt, kind, i, h, t in batch.itertuples(index=False):
                if (part, salt) != group:
                    group, own, finder = (part, salt), [], None
                if kind == 0:
                    own.append((i, t))
                else:
                    finder = finder or LeakFinder(own, least)
                    out += [(i, h, start, end, k) for start, end, ids in finder.spans(normal(t)) for k in ids]
            yield pd.DataFrame(out, columns=["doc_id", "h", "start", "end", "item_id"]).astype("int64")

    ordered = rows.repartition("part", "__salt").sortWithinPartitions("part", "__salt", "kind")
    return ordered.mapInPandas(match, "doc_id long, h long, start long, `end` long, item_id long")


def leaks(docs: DataFrame, eval_items: DataFrame, doc: str, text: str, item: str, expected: str, least: int = 40, chars: int = AUTOMATON_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Documents that share at least ``least`` consecutive characters with a test item: ``doc_id``, ``item_id``, ``chars``.

    Compared are letters and digits only, after NFKC and lower-casing; ``chars`` is the longest shared span. Items of up
    to ``chars`` characters altogether make one automaton, which goes to the tasks in one broadcast; every document is
    streamed past it once, and only hits are shuffled. More items are divided among several automata, which are made
    in the tasks, see _spans_in_parts(); the result is the same.

    Defined cases: null or short texts and items share nothing; repeated rows and copies count once per
    document id; documents without id take no part; no items or no documents give an empty result.
    """
    items, size = _items(eval_items, item, expected, least)
    texts = _texts(docs, doc, text)
    if size > chars:
        found = _spans_in_parts(texts, items, math.ceil(size / chars), least, hot_rows).select("doc_id", "item_id", (F.col("end") - F.col("start")).alias("chars"))
    else:
        held = docs.sparkSession.sparkContext.broadcast(_collected(items, least))

        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = held.value
            for batch in batches:
                hits = [(d, k, end - start) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for start, end, ids in find.spans(normal(t)) for k in ids]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "chars"]).astype("int64")

        found = texts.mapInPandas(match, "doc_id long, item_id long, chars long")
    return found.groupBy("doc_id", "item_id").agg(F.max("chars").alias("chars"))


def leak_report(docs: DataFrame, eval_items: DataFrame, doc: str, text: str, item: str, expected: str, least: int = 40) -> DataFrame:
    """How far each test item leaked: ``item_id``, ``docs`` that hold a part of it, ``longest`` shared span. Items that did not leak are absent."""
    return leaks(docs, eval_items, doc, text, item, expected, least).groupBy("item_id").agg(F.count("*").alias("docs"), F.max("chars").alias("longest"))


def scrub(docs: DataFrame, eval_items: DataFrame, doc: str, text: str, item: str, expected: str, least: int = 40, most_share: float = 0.5, chars: int = AUTOMATON_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Documents without the leaked spans: ``doc_id``, ``text``, ``removed_chars``, ``dropped``.

    Every shared span of at least ``least`` characters is cut out of the text, from its first letter or digit to
    its last with the marks on it; characters that NFKC joins, such as decomposed jamo, are cut together. Where the
    spans cover more than ``most_share`` of a document's letters and digits, the whole text is dropped (null,
    ``dropped`` true). Only documents that hold a span come out. Items are matched as in leaks().

    Defined cases: as in leaks(); rows equal in id and text come out once.
    """
    items, size = _items(eval_items, item, expected, least)
    texts = _texts(docs, doc, text)
    schema = "doc_id long, text string, removed_chars long, dropped boolean"

    def cleaned(rows: Iterator[tuple[int, str, list[tuple[int, int]]]]) -> pd.DataFrame:
        return pd.DataFrame([(d, *r) for d, t, spans in rows if (r := cut_spans(t, spans, most_share))], columns=["doc_id", "text", "removed_chars", "dropped"])

    if size > chars:
        spans = _spans_in_parts(texts, items, math.ceil(size / chars), least, hot_rows).select("doc_id", "h", "start", "end").distinct()
        own = spans.groupBy("doc_id", "h").agg(F.collect_list(F.array("start", "end")).alias("spans"))
        rows = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).join(own, ["doc_id", "h"]).select("doc_id", "text", "spans")

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield cleaned((d, t, [tuple(x) for x in s]) for d, t, s in batch.itertuples(index=False))

        return rows.mapInPandas(cut, schema)
    held = docs.sparkSession.sparkContext.broadcast(_collected(items, least))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield cleaned((d, t, [(a, b) for a, b, _ in held.value.spans(normal(t))]) for d, t in batch.itertuples(index=False))

    return texts.mapInPandas(clean, schema).distinct()


def segments(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the shortest pieces that NFKC changes independently of each other, in order.

    A piece grows by every character that is a mark, becomes one, or joins with what is before it, such as the
    vowel and the final consonant of a Korean syllable in decomposed jamo.
    """
    at, done = 0, ""
    for end in range(1, len(text) + 1):
        done = done or unicodedata.normalize("NFKC", text[at:end])
        if end < len(text):
            one = unicodedata.normalize("NFKC", text[end])
            joined = unicodedata.normalize("NFKC", done + text[end])
            if unicodedata.combining(text[end]) or unicodedata.combining(one[:1] or "a") or joined != done + one:
                done = joined
                continue
        yield at, end
        at, done = end, ""


def owners(text: str) -> list[tuple[int, int]]:
    """For each character of the normalised text, the start and end of the piece of ``text`` that it comes from.

    Pieces are those that NFKC leaves apart. Should the pieces of a line not add up to its normalised form, the whole
    line is one piece: NFKC joins nothing across a line feed.
    """
    out: list[tuple[int, int]] = []
    at = 0
    for line in text.split("\n"):
        own = [(a, b) for a, b in segments(line) for _ in range(len(normal(line[a:b])))]
        whole = len(normal(line))
        out += [(at + a, at + b) for a, b in own] if len(own) == whole else [(at, at + len(line))] * whole
        at += len(line) + 1
    return out


def cut_spans(text: str, spans: list[tuple[int, int]], most_share: float) -> tuple[str | None, int, bool] | None:
    """``text`` without the ``spans`` of its normalised form, the characters removed and whether all of it goes; None without spans."""
    if not spans:
        return None
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    if sum(e - s for s, e in merged) > most_share * len(normal(text)):
        return None, len(text), True
    owner = owners(text)
    out, done = [], 0
    for start, end in merged:
        out.append(text[done : max(done, owner[start][0])])
        done = owner[end - 1][1]
    out.append(text[done:])
    kept = "".join(out)
    return kept, len(text) - len(kept), False
