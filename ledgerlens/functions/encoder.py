"""Text encoders: batches of texts to unit vectors, with an encoder that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1.0)


def onnx_encoder(model: str, tokenize: Callable[[str], list[int]]) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Makes, in each task, an encoder from an ONNX model in a file that executors can read: the first token's last hidden state."""

    def make() -> Callable[[list[str]], np.ndarray]:
        import onnxruntime

        session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        known = {i.name for i in session.get_inputs()}

        def encode(texts: list[str]) -> np.ndarray:
            ids = [tokenize(t) for t in texts]
            shape = len(ids), max(map(len, ids))
            feed = {n: np.zeros(shape, dtype=np.int64) for n in ("input_ids", "attention_mask", "token_type_ids")}
            for k, own in enumerate(ids):
                feed["input_ids"][k, : len(own)] = own
                feed["attention_mask"][k, : len(own)] = 1
            return session.run(None, {n: v for n, v in feed.items() if n in known})[0][:, 0]

        return encode

    return make


def embedder(make: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32) -> Callable[[Column], Column]:
    """A column function from texts to unit vectors. ``make`` is called once per task; texts are encoded ``batch`` at a time; null is the empty text."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for part in texts:
            plain = ["" if t is None else t for t in part]
            vectors = [v for k in range(0, len(plain), batch) for v in unit_rows(np.asarray(encode(plain[k : k + batch]), dtype=float)).astype(np.float32)]
            yield pd.Series(vectors, index=part.index)

    return lambda text: run(text)
