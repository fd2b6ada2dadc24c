"""Plug-ins at the model boundary, and deterministic stand-ins for tests. No model ships with the engine."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temporis.functions import vector
from temporis.operators.retrieval import encode


#: What SQL's \w matches: no letter or digit outside ASCII.
SQL_WORD = "[0-9A-Za-z_]"


class Encoder(Protocol):
    """A batch of values -> a vector or None (unreadable) each."""

    def __call__(self, values: list) -> list[list[float] | None]: ...


class HashingEncoder:
    """Unit vectors of hashed words; equal texts have equal vectors. A null or empty value is unreadable.

    Words after the first most_tokens take no part, as in the reference's tokenizer; with None all do. Words are of any script; a value without a
    match of `needs`, where given, is unreadable too."""

    def __init__(self, dim: int = 64, most_tokens: int | None = 77, needs: str | None = None) -> None:
        self.dim, self.most_tokens, self.needs = dim, most_tokens, needs

    def __call__(self, values: list) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for value in values:
            readable = self.needs is None or re.search(self.needs, value or "")
            words = re.findall(r"\w+", value.lower())[: self.most_tokens] if value and readable else []
            v = np.zeros(self.dim)
            for w in words:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1 if h >> 63 else -1
            if words and not v.any():  # words that cancel out still are a text
                v[0] = 1
            n = float(np.sqrt((v**2).sum()))
            out.append((v / n).tolist() if n else None)
        return out


def encode_modalities(rows: DataFrame, registry: dict[str, Encoder], scales: dict[str, float] | None = None) -> DataFrame:
    """rows (item_id, modality, value) -> item_id, modality, embedding: each modality by its encoder, unit length, then times
    exp(scale) where one is set. An unknown modality has status "no encoder"."""
    parts = None
    for name, encoder in registry.items():
        done = encode(rows.where(F.col("modality") == name), encoder, "value")
        unit = vector.normalise(F.col("embedding"))
        if scales and name in scales:
            unit = vector.scale(unit, F.lit(scales[name]))
        done = done.withColumn("embedding", unit).select("item_id", "modality", "embedding", "status")
        parts = done if parts is None else parts.unionByName(done)
    other = rows.where(~F.col("modality").isin(*registry)).select("item_id", "modality", F.lit(None).cast("array<double>").alias("embedding"), F.lit("no encoder").alias("status"))
    return other if parts is None else parts.unionByName(other)


def as_map(vectors: DataFrame) -> DataFrame:
    """item_id, embeddings: modality -> vector."""
    pairs = F.array_sort(F.collect_list(F.struct("modality", "embedding")))
    return vectors.where("embedding is not null").groupBy("item_id").agg(F.map_from_entries(pairs).alias("embeddings"))


def scripted_model(lines: list[str]) -> Callable[[str], str]:
    """A model that says the n-th line in round n of a conversation (told by the assistant turns in the prompt)."""

    def say(prompt: str) -> str:
        n = len(re.findall(r"(?m)^assistant: ", prompt))
        return lines[min(n, len(lines) - 1)]

    return say
