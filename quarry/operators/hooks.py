"""Plug-in points for models: callables over batches of rows, run by Spark tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Batches = Iterator[pd.DataFrame]
Model = Callable[[Batches], Batches]


def apply_model(rows: DataFrame, model: Model, schema: str, tasks: int | None = None) -> DataFrame:
    """Run a model over a prompt or text table. ``tasks`` bounds how many calls run at once."""
    if tasks:
        rows = rows.repartition(tasks)
    return rows.mapInPandas(model, schema)


def text_hash_embedder(dim: int = 64) -> Model:
    """Deterministic unit vectors from the text's hash, for tests."""

    def one(text: str) -> list[float]:
        seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
        v = np.random.default_rng(seed).standard_normal(dim)
        return (v / np.linalg.norm(v)).tolist()

    def run(batches: Batches) -> Batches:
        for pdf in batches:
            yield pdf.assign(embedding=[one(t) for t in pdf["text"]])

    return run
