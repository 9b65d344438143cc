"""Embedding passes that skip what is done, encode every distinct text once, and prune what is gone."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import ship

Encoder = Callable[[list[str]], np.ndarray]


def hashed_encoder(dim: int = 64) -> Encoder:
    """Words added up in a fixed number of directions, to unit length: a stand-in for a model behind the same call."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, (h >> 1) % dim] += 1 if h & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def pending(docs: DataFrame, present: DataFrame, stamp: str) -> DataFrame:
    """Distinct (sha256, text) that have no vector under this stamp."""
    texts = docs.select(F.sha2("text", 256).alias("sha256"), "text").filter("text is not null").dropDuplicates(["sha256"])
    return texts.join(present.filter(F.col("stamp") == stamp).select("sha256"), "sha256", "left_anti")


def encoded(texts: DataFrame, encode: Encoder, stamp: str, ladder: tuple[int, ...] = (10_000, 8_000, 6_000, 4_000)) -> DataFrame:
    """sha256, stamp, vector, used: the whole text; one that fails is tried again shorter, down the ladder; null if all fail."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sha, text in zip(pdf["sha256"], pdf["text"], strict=True):
                vector = used = None
                for n in (len(text), *(x for x in ladder if x < len(text))):
                    try:
                        vector, used = encode([text[:n]])[0].astype("float32"), n
                        break
                    except ValueError:
                        continue
                rows.append((sha, stamp, vector, used))
            yield pd.DataFrame(rows, columns=["sha256", "stamp", "vector", "used"])

    return texts.mapInPandas(run, "sha256 string, stamp string, vector array<float>, used int")


def pruned(present: DataFrame, docs: DataFrame, stamp: str) -> DataFrame:
    """Vectors of texts that are still there, under the live stamp."""
    live = docs.select(F.sha2("text", 256).alias("sha256")).distinct()
    return present.filter(F.col("stamp") == stamp).join(live, "sha256", "left_semi")
