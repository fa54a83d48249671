"""Keyword search and vector search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import cut, keyword_patterns, like_any

#: Vectors that are multiplied with others at once.
BLOCK = 1024
#: Lines and columns of cells in which blocks of queries and rows meet.
GRID = 8


def clamp(limit: int, default: int, most: int) -> int:
    return default if limit <= 0 else min(limit, most)


def matches(kv: DataFrame, keyword: str) -> DataFrame:
    """Rows whose key or value holds the keyword: letters A to Z in any case, other letters as written or with a capital first one."""
    p = keyword_patterns(keyword)
    return kv.where(like_any(F.col("key"), p) | like_any(F.col("value"), p))


def find(kv: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    """The first matches by key: 20 for a limit of 0 or less, 100 at most. An empty keyword matches all."""
    return matches(kv, keyword).select("key", "value", "created_at").orderBy("key").limit(clamp(limit, 20, 100))


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine of a vector column and a fixed vector; null for a zero vector or another dimension."""
    q = [float(x) for x in query]
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, F.array(*[F.lit(x) for x in q]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) * F.lit(float(np.sqrt(np.dot(q, q))))
    return F.when((F.size(vector) == len(q)) & (norm > 0), dot / norm)


def search(embeddings: DataFrame, query: Sequence[float], limit: int = 10) -> DataFrame:
    """key, score of the `limit` most similar rows, 50 at most. Rows without a vector or a score do not show."""
    scored = embeddings.where(F.col("embedding").isNotNull()).select("key", cosine(F.col("embedding"), query).alias("score"))
    return scored.where(F.col("score").isNotNull()).orderBy(F.desc("score"), "key").limit(clamp(limit, 10, 50))


def with_values(found: DataFrame, values: DataFrame, width: int = 200) -> DataFrame:
    """Hits with the beginning of their content, else of their summary; hits without a value stay."""
    v = values.select("key", F.lit(True).alias("_v"), "content", "summary")
    text = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("summary"), F.lit(""))
    return found.join(v, "key", "left").select("key", "score", cut(text, width).alias("content"))


def as_json(found: DataFrame, kv: DataFrame) -> DataFrame:
    """json of each hit (key, score), best first: key, score and the whole value, which is null where there is none."""
    rows = found.join(kv.select("key", "value"), "key", "left")
    return rows.orderBy(F.desc("score"), "key").select(F.to_json(F.struct("key", "score", "value")).alias("json"))


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) in blocks: arrays of ids and of the vectors' numbers, unit length; rows of zero vectors are left out."""
    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(start, BLOCK)
            lists = batch.column(1)
            d = len(lists[0]) if len(lists) else 0
            m = np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, d)
            norm = np.linalg.norm(m, axis=1)
            keep = norm > 0
            m = (m[keep] / norm[keep, None]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column(0))[keep]]), pa.array([m.ravel()]), pa.array([d], pa.int32())], ["ids", "numbers", "d"])


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qi, q, d, ri, r = (batch.column(c)[i].values if c not in (2,) else batch.column(c)[i].as_py() for c in range(5))
                qi, ri = np.asarray(qi), np.asarray(ri)
                s = np.asarray(q).reshape(-1, d) @ np.asarray(r).reshape(-1, d).T
                n = min(k, len(ri))
                if not n:
                    continue
                # Ties at the k-th place are kept, so that the choice by id stays exact.
                least = np.partition(s, -n, axis=1)[:, -n]
                a, b = np.nonzero(s >= least[:, None] - 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array(qi[a]), pa.array(ri[b]), pa.array(s[a, b])], ["query_id", "id", "score"])

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, grid: int = GRID) -> DataFrame:
    """query_id, id, score, rank: the k rows most similar to each query, by cosine, ties by id. queries, rows: id (bigint), vector (array<float>, one dimension).

    Both sides are packed in blocks, every block of queries meets every block of rows in one matrix product, which keeps k rows for each
    query; what is shuffled is k rows for each query and block, never all pairs.

    Blocks meet on a grid of `grid` x `grid` cells: a block of queries goes to one line of cells, a block of rows to one column, so that the work is
    even over the cells and each side is copied `grid` times, whatever its size.
    """
    pack = lambda df: df.where(F.col("vector").isNotNull()).select("id", "vector").mapInArrow(_block, "ids array<bigint>, numbers array<double>, d int")
    cells = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    line = lambda ids: F.pmod(F.xxhash64(ids), F.lit(grid)).cast("int")
    q = pack(queries).select(F.col("ids").alias("qi"), F.col("numbers").alias("q"), "d", line("ids").alias("x"), cells.alias("y"))
    r = pack(rows).select(F.col("ids").alias("ri"), F.col("numbers").alias("r"), "d", cells.alias("x"), line("ids").alias("y"))
    met = q.hint("shuffle_hash").join(r, ["d", "x", "y"]).select("qi", "q", "d", "ri", "r")
    best = met.mapInArrow(_best(k), "query_id bigint, id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
