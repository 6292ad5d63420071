"""Reading level of documents: sentence classifiers and a calibrated aggregate of their distributions."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.runtime import BROADCAST_ROWS

#: Hashed features per sentence model and the labelled documents the models are fitted on, at most.
FEATURES, LABELLED = 1 << 15, 1000
LEVELS = 5
#: Expected sentence levels at which a document's distribution is read, and the features that gives.
LEVEL_CUTS = (1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5)
DOCUMENT_FEATURES = 2 * len(LEVEL_CUTS) + 1
_END = re.compile(r"[^。！？!?；;\n\r]*?(?:[。！？!?；;\n\r]+|\.(?=\s|$))|[^。！？!?；;\n\r]+")
_WORD = re.compile(r"[A-Za-z]+")


def sentences(text: str) -> list[str]:
    """The sentences of a text, without those that hold no letter or digit."""
    return [s for m in _END.finditer(text) if (s := m.group().strip()) and any(c.isalnum() for c in s)]


def _hash(codes: np.ndarray, salt: int) -> np.ndarray:
    x = (codes + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.int64) & (FEATURES // 2 - 1)


def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of sentences: feature numbers, the sentence of each, and a weight that gives every sentence length-independent mass.

    The first half of the numbers holds the character model (pairs), the second half the word model:
    Latin words with their neighbours, and bands of sentence and clause length.
    """
    plain = [p.lower() for p in parts]
    codes = np.frombuffer("\n\n".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(p) for p in plain), dtype=np.int64, count=len(plain))
    owner = np.repeat(np.arange(len(plain)), sizes + 2)[: len(codes)]
    digit = (codes >= 48) & (codes <= 57)
    codes = np.where(digit, np.uint64(48), codes)
    two = codes[:-1] * np.uint64(1 << 21) + codes[1:]
    inside = (codes[:-1] != 10) & (codes[1:] != 10)
    index, of = [_hash(two, 1)[inside]], [owner[:-1][inside]]
    words, word_of = [], []
    for k, p in enumerate(plain):
        own = [f"#{min(12, int(np.log2(len(p) + 1) * 2))}", f"@{min(9, p.count('，') + p.count(','))}"]
        if p.isascii() or _WORD.search(p):
            tokens = _WORD.findall(p)
            own += tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)]
            own.append(f"~{int(np.mean([len(w) for w in tokens])) if tokens else 0}")
        words += [FEATURES // 2 + (zlib.crc32(w.encode()) & (FEATURES // 2 - 1)) for w in own]
        word_of += [k] * len(own)
    index.append(np.array(words, dtype=np.int64))
    of.append(np.array(word_of, dtype=np.int64))
    all_index, all_of = np.concatenate(index), np.concatenate(of)
    char = all_index < FEATURES // 2
    mass = np.where(char, np.bincount(all_of[char], minlength=len(plain))[all_of], np.bincount(all_of[~char], minlength=len(plain))[all_of])
    return all_index, all_of, 1.0 / np.sqrt(np.maximum(mass, 1))


def _scores(weights: np.ndarray, bias: np.ndarray, index: np.ndarray, of: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((n, weights.shape[1]))
    for k in range(weights.shape[1]):
        out[:, k] = np.bincount(of, weights=weights[index, k] * value, minlength=n) + bias[k]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class ReadingModel:
    """Sentence classifiers and the calibration of documents."""

    weights: np.ndarray
    bias: np.ndarray
    document: np.ndarray
    cuts: np.ndarray

    def sentence_levels(self, parts: list[str]) -> np.ndarray:
        """Probability of each level for each sentence."""
        return _softmax(_scores(self.weights, self.bias, *features(parts), len(parts)))

    def difficulty(self, documents: list[list[str]]) -> np.ndarray:
        """Calibrated difficulty of each document, on the scale of the labels; NaN for one without sentences."""
        parts = [s for d in documents for s in d]
        if not parts:
            return np.full(len(documents), np.nan)
        return _aggregate(self.sentence_levels(parts), parts, documents) @ self.document


def _aggregate(levels: np.ndarray, parts: list[str], documents: list[list[str]]) -> np.ndarray:
    """Per document, the distribution of its sentences' levels: the shares above each cut of LEVEL_CUTS, by sentence and by length; and a constant.

    Shares of sentences rather than mean probabilities, since the models are surer of some languages and forms than of others.
    """
    sizes = np.array([len(d) for d in documents])
    of = np.repeat(np.arange(len(documents)), sizes)
    length = np.array([len(s) for s in parts], dtype=float)
    by_length = np.bincount(of, weights=length, minlength=len(documents))
    expected = levels @ np.arange(1, LEVELS + 1)
    out = np.full((len(documents), DOCUMENT_FEATURES), np.nan)
    for k, cut in enumerate(LEVEL_CUTS):
        above = (expected >= cut).astype(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[:, 2 * k] = np.bincount(of, weights=above, minlength=len(documents)) / sizes
            out[:, 2 * k + 1] = np.bincount(of, weights=above * length, minlength=len(documents)) / by_length
    out[:, -1] = np.where(sizes > 0, 1.0, np.nan)
    return out


def _ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    return np.linalg.solve(x.T @ x + penalty * np.eye(x.shape[1]), x.T @ y)


def _fit_sentences(parts: list[str], target: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression with an L2 penalty, by full gradients with per-feature step sizes."""
    index, of, value = features(parts)
    weights, bias = np.zeros((FEATURES, LEVELS)), np.log(target.mean(axis=0) + 1e-3)
    seen = np.full((FEATURES, LEVELS), 1e-8)
    n = len(parts)
    for _ in range(rounds):
        error = _softmax(_scores(weights, bias, index, of, value, n)) - target
        for k in range(LEVELS):
            gradient = np.bincount(index, weights=error[of, k] * value, minlength=FEATURES) / n + penalty * weights[:, k]
            seen[:, k] += gradient * gradient
            weights[:, k] -= 0.5 * gradient / np.sqrt(seen[:, k])
        bias -= error.mean(axis=0)
    return weights, bias


def fit(texts: list[str], ratings: list[list[int]], penalty: float = 1e-5, rounds: int = 20) -> ReadingModel:
    """Fit the models to texts and their raters' levels.

    Every sentence starts with its document's ratings as target. After a first fit, targets are sharpened once:
    a sentence's target is the product of its document's smoothed ratings and the fitted distribution, so that
    easy and hard sentences inside mixed documents find their own level. Document difficulty is a ridge
    regression on the aggregated distributions, fitted on documents held out from the sentence models (two halves
    in turn); place_cuts() turns the final model's scale into levels.
    """
    documents = [sentences(t) for t in texts]
    keep = [k for k, d in enumerate(documents) if d and ratings[k]]
    documents, ratings = [documents[k] for k in keep], [ratings[k] for k in keep]
    if not documents:
        return ReadingModel(np.zeros((FEATURES, LEVELS)), np.zeros(LEVELS), np.r_[np.zeros(DOCUMENT_FEATURES - 1), 3.0], np.arange(1.5, LEVELS))
    share = np.array([np.bincount(np.clip(r, 1, LEVELS) - 1, minlength=LEVELS) / len(r) for r in ratings])
    mean = share @ np.arange(1, LEVELS + 1)

    def train(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [s for k in which for s in documents[k]]
        of = np.repeat(which, [len(documents[k]) for k in which])
        smooth = share[of] * 0.7 + 0.3 / LEVELS
        weights, bias = _fit_sentences(parts, share[of], penalty, rounds)
        own = _softmax(_scores(weights, bias, *features(parts), len(parts)) * 1.5) * smooth
        return _fit_sentences(parts, own / own.sum(axis=1, keepdims=True), penalty, rounds)

    everything = np.arange(len(documents))
    x = np.zeros((len(documents), DOCUMENT_FEATURES))
    for held in (everything[::2], everything[1::2]) if len(documents) >= 4 else (everything,):
        rest = np.setdiff1d(everything, held) if len(documents) >= 4 else everything
        parts = [s for k in held for s in documents[k]]
        levels = _softmax(_scores(*train(rest), *features(parts), len(parts)))
        x[held] = _aggregate(levels, parts, [documents[k] for k in held])
    document = _ridge(x, mean, 1e-3 * len(documents))
    model = ReadingModel(*train(everything), document, np.arange(1.5, LEVELS))
    model.cuts = place_cuts(model.difficulty(documents), mean)
    return model


def place_cuts(score: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Four increasing cuts on the difficulty scale, midway between the median scores of neighbouring levels.

    A document counts for the level nearest to its raters' mean, one halfway between two levels for neither; medians
    keep single mistaken ratings from moving a cut. A level that no document has stands at its own number.
    """
    nearest = np.where(np.abs(mean - np.rint(mean)) < 0.5, np.clip(np.rint(mean), 1, LEVELS), 0)
    middle = np.array([np.median(score[nearest == k]) if (nearest == k).any() else k for k in range(1, LEVELS + 1)])
    middle = np.maximum.accumulate(middle)
    return (middle[:-1] + middle[1:]) / 2


def labelled_sample(docs: DataFrame, labels: DataFrame, doc: str, text: str, level: str, rater: str, most: int = LABELLED) -> tuple[list[str], list[list[int]]]:
    """Texts and ratings of at most ``most`` labelled documents, chosen by the hash of their id; repeated ratings count once."""
    clean = labels.select(F.col(doc).alias("id"), F.col(rater).alias("rater"), F.col(level).cast("int").alias("level")).where("id is not null and level between 1 and 5").distinct()
    rated = clean.groupBy("id").agg(F.sort_array(F.collect_list("level")).alias("levels")).orderBy(F.xxhash64("id"), "id").limit(min(most, BROADCAST_ROWS))
    texts = docs.select(F.col(doc).alias("id"), F.col(text).alias("text")).where(F.char_length("text") > 0)
    rows = texts.join(F.broadcast(rated), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("levels").alias("levels")).orderBy("id").collect()
    return [r["text"] for r in rows], [list(r["levels"]) for r in rows]


def reading_levels(docs: DataFrame, model: ReadingModel, doc: str, text: str) -> DataFrame:
    """``doc_id``, ``level`` (1 to 5), ``difficulty`` on the labels' scale, ``n_chars``, ``n_sentences`` of every document.

    Whole texts are classified, sentence by sentence, in one pass without a shuffle of texts; the fitted model is of
    fixed size and is broadcast.

    Defined cases: null and empty texts and texts without letters have null level and difficulty; repeated rows
    come out once; different texts of one id each come out; rows without id take no part.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.document, model.cuts))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = ReadingModel(*held.value)
        for batch in batches:
            for part in range(0, len(batch), 500):
                rows = batch.iloc[part : part + 500]
                texts = [t or "" for t in rows["text"]]
                documents = [sentences(t) for t in texts]
                hard = own.difficulty(documents)
                level = np.searchsorted(own.cuts, hard, side="right") + 1
                yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "level": pd.array(np.where(np.isnan(hard), None, level), dtype="Int32"), "difficulty": pd.array([None if np.isnan(h) else round(float(h), 6) for h in hard], dtype="Float64"), "n_chars": [len(t) for t in texts], "n_sentences": [len(d) for d in documents]})

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    return rows.mapInPandas(score, "doc_id long, level int, difficulty double, n_chars long, n_sentences long").distinct()
