"""Extension points: extractors, embedding backends and rerankers as plain callables.

A callable is made once for each Python worker (`make`) and gets batches of rows, so a model is loaded once.
The defaults are deterministic and need nothing outside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import evidence

Extractor = Callable[[pd.DataFrame], pd.DataFrame]
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]


def extract(chunks: DataFrame, make: Callable[[], Extractor] | None, schema: str, terms: Sequence[str] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Evidence by a custom extractor, or by the engine's own."""
    if make is None:
        return evidence.extracted(chunks, terms, key=key, text=text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = make()
        for batch in batches:
            yield extractor(batch)

    return chunks.mapInPandas(run, schema)


def hashed_embedder(width: int = 64) -> Embedder:
    """Signed hashing of words, normalised: a stand-in where no model is given."""

    def embed(texts: Sequence[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            v = np.zeros(width, np.float32)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % width] += 1 if h >> 32 & 1 else -1
            n = float(np.linalg.norm(v))
            out.append((v / n).tolist() if n else None)
        return out

    return embed


def embeddings(rows: DataFrame, existing: DataFrame | None, make: Callable[[], Embedder] = hashed_embedder, key: str = "evidence_id", text: str = "statement", force: bool = False) -> DataFrame:
    """(key, vector) of rows without one, or of all; texts that give no vector drop out."""
    wanted = rows.select(key, text) if force or existing is None else rows.select(key, text).join(existing.select(key), key, "left_anti")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "vector": list(embed(batch[text].tolist()))})

    return wanted.mapInPandas(run, f"`{key}` {kind}, vector array<float>").filter("vector is not null")


def unknown(rows: DataFrame, key: str, ids: str, known: DataFrame, known_id: str) -> DataFrame:
    """(key, id): ids that records name and nothing has."""
    named = rows.select(key, F.explode(ids).alias("id")).distinct()
    return named.join(known.select(F.col(known_id).alias("id")).distinct(), "id", "left_anti").select(key, "id")


def all_covered(required: DataFrame, present: DataFrame, key: str) -> bool:
    """Whether every required key is present (a subset test)."""
    return required.select(key).join(present.select(key).distinct(), key, "left_anti").limit(1).count() == 0
