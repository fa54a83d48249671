"""Vectors of texts. The embedder is any function from a list of texts to a list of vectors; one that needs no model is here."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
_WORD = re.compile(r"[^\W_]+")


def hashed_words(texts: list[str], size: int = 64) -> list[list[float]]:
    """Counts of hashed words, of length one: texts with words in common are alike. Texts without words have zero vectors, which nothing is similar to."""
    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in _WORD.findall(t.lower()):
            h = zlib.crc32(w.encode())
            out[i, h % size] += 1.0 if h & 0x10000 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).tolist()


def embedded(rows: DataFrame, embed: Embedder) -> DataFrame:
    """key, embedding of rows (key, text), in batches inside the tasks; blank and null texts have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(embed(batch.column(1).to_pylist()), pa.list_(pa.float32()))], ["key", "embedding"])

    some = rows.where(F.col("key").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return some.select("key", "text").mapInArrow(run, "key string, embedding array<float>")
