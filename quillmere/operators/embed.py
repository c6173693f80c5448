"""Embedders: an interface, and a deterministic one for tests and for corpora without a model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Chained SHA-256 digests of the text, as numbers from -1 to 1, scaled to unit length."""

    def __init__(self, dimension: int = 1024) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            digest, data = hashlib.sha256(t.encode()).digest(), b""
            while len(data) < self.dimension:
                data += digest
                digest = hashlib.sha256(digest).digest()
            v = np.frombuffer(data[: self.dimension], np.uint8).astype(np.float64) / 255.0 * 2.0 - 1.0
            out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
        return out


def mean_pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors (texts, dimension) from a model's hidden states (texts, tokens, dimension): the mean over the tokens that the
    mask keeps. A text without tokens is the zero vector."""
    kept = mask.astype(np.float32)[:, :, None]
    mean = (hidden * kept).sum(1) / np.maximum(kept.sum(1), 1e-9)
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def embedding(embedder: Embedder):
    """A vectorised column function; the embedder travels once to each worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = embedder.embed(texts.fillna("").tolist())
            if any(len(v) != embedder.dimension for v in found):
                raise ValueError(f"the embedder gave vectors of another length than {embedder.dimension}")
            yield pd.Series(found)

    return run
