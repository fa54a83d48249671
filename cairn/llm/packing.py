"""Filling fixed-capacity containers with items (problem 8).

Items go into blocks of bounded size; each block is packed by itself. Patterns of few different lengths that fill a
container up to a window are enumerated, non-negative least squares say how often each pattern should be repeated to use
up the block's histogram of lengths, the counts are rounded down, and what is left is packed greedily, largest first.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that byte-level vocabularies of 50,000 ranks cut texts with before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items in a block, about; a block's waste is at most some containers, whatever their number.
BLOCK = 20_000
#: A pattern may leave this share of the capacity unused; patterns that begin with one length; sweeps of the least squares.
WINDOW, PATTERNS, SWEEPS = 1 / 64, 12, 30
ASSIGNED = "capacity int, container string, doc_id bigint, piece int, start_token bigint, tokens bigint"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A tokenizer from a rank file (tiktoken form) or a JSON file (tokenizers form), as a function from text to the number of tokens."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(own.encode_ordinary(text))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def _sizes(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer(SparkFiles.get(name))
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "sig", "n"])

    return run


def sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n (tokens of the text, 0 for null and empty), uid, written once. uid is made of the id, the text and, for repeated rows, their
    number, so it does not depend on how the files are cut. The tokenizer's file is read by the driver and sent to the executors."""
    documents.sparkSession.sparkContext.addFile(path)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("sig"), "text").mapInArrow(_sizes(os.path.basename(path)), "doc_id bigint, sig bigint, n bigint")
    repeated = rows.groupBy("doc_id", "sig", "n").count().withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count"))))
    return stage(repeated.select("doc_id", "n", F.concat_ws(".", "doc_id", "sig", "k").alias("uid")), "sizes")


def patterns(lengths: list[int], counts: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """Combinations of few lengths that fill the capacity but for the window. Each length begins PATTERNS of them at most.

    A length as often as it fits, or less, and one or two others that fill the rest best.
    """
    window = int(capacity * WINDOW)
    out = []

    def fit(room: int) -> int:
        """The largest length that fits, 0 for none."""
        k = bisect_right(lengths, room)
        return lengths[k - 1] if k else 0

    for a in reversed(lengths):
        made = 0
        most = min(capacity // a, counts[a])
        for k in range(most, max(0, most - 4), -1):
            room = capacity - k * a
            if room <= window:
                out.append({a: k})
                made += 1
            top = bisect_right(lengths, min(room, a - 1))
            for j in range(top - 1, max(-1, top - 3), -1):  # one filler
                if room - lengths[j] <= window:
                    out.append({a: k, lengths[j]: 1})
                    made += 1
            for part in (2, 3, 4):  # a filler of a part of the room, and one that fills the rest
                b = fit(min(room - room // part, a - 1))
                c = fit(room - b) if b else 0
                if b and c and c < a and room - b - c <= window:
                    p = {a: k}
                    for x in (b, c):
                        p[x] = p.get(x, 0) + 1
                    out.append(p)
                    made += 1
            if made >= PATTERNS:
                break
    return out


def repeat_counts(patterns_: list[dict[int, int]], counts: dict[int, int]) -> list[float]:
    """Non-negative least squares of repeats x patterns against the histogram, by coordinate descent."""
    rest = {k: float(v) for k, v in counts.items()}
    cols = [(tuple(p.items()), sum(n * n for n in p.values())) for p in patterns_]
    x = [0.0] * len(cols)
    for _ in range(SWEEPS):
        moved = 0.0
        for j, (items, norm) in enumerate(cols):
            new = max(0.0, x[j] + sum(n * rest[k] for k, n in items) / norm)
            if (d := new - x[j]) != 0.0:
                x[j] = new
                moved = max(moved, abs(d))
                for k, n in items:
                    rest[k] -= d * n
        if moved < 0.05:
            break
    return x


def pack(items: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (0 < size <= capacity); no container holds more than the capacity."""
    where: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(items.tolist()):
        where[n].append(i)
    counts = {k: len(v) for k, v in where.items()}
    out = np.full(len(items), -1, np.int64)
    used = 0
    lengths = sorted(counts)
    found = patterns(lengths, counts, capacity)
    repeats = repeat_counts(found, counts)
    for j in sorted(range(len(found)), key=lambda j: -repeats[j]):
        p = found[j]
        times = min([int(repeats[j] + 1e-9), *(len(where[k]) // n for k, n in p.items())])
        for _ in range(times):
            for k, n in p.items():
                for _ in range(n):
                    out[where[k].pop()] = used
            used += 1
    left = [k for k in lengths if where[k]]
    while left:
        room = capacity
        while (at := bisect_right(left, room)) > 0:
            k = left[at - 1]
            n = min(room // k, len(where[k]))
            for _ in range(n):
                out[where[k].pop()] = used
            room -= n * k
            if not where[k]:
                left.pop(at - 1)
            elif room >= k:
                break
        used += 1
    return out


def _pack_block(group: pd.DataFrame) -> pd.DataFrame:
    capacity, block = int(group["capacity"].iloc[0]), int(group["block"].iloc[0])
    group = group.sort_values("uid", kind="stable").reset_index(drop=True)
    number = pack(group["rest"].to_numpy(), capacity)
    return pd.DataFrame({
        "capacity": np.int32(capacity), "container": [f"b{block}-{k}" for k in number], "doc_id": group["doc_id"],
        "piece": (group["n"] // capacity).astype("int32"), "start_token": group["n"] - group["rest"], "tokens": group["rest"],
    })


def assign(documents: DataFrame, capacities: list[int], path: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """capacity, container, doc_id, piece, start_token, tokens: every document in containers of every capacity.

    A document that exceeds the capacity fills containers of its own, and its last piece is packed with the other items; no other
    document is split. Documents without tokens (null or empty texts) need no place and are left out. Repeated rows are items each.
    Capacities that are null or not positive, and repeats of one, are left out; an empty table gives no rows.

    Documents are hashed to blocks of about `block` items, so no task holds more, and copies do not meet in one.
    """
    spark = documents.sparkSession
    items = sizes(documents, path).where(F.col("n") > 0)
    wanted = sorted({int(c) for c in capacities if c is not None and c > 0})
    if not wanted:
        return spark.createDataFrame([], ASSIGNED)
    blocks = max(1, -(-items.count() // block))
    each = items.withColumn("capacity", F.explode(F.array(*[F.lit(c).cast("int") for c in wanted])))
    each = each.withColumn("rest", F.col("n") % F.col("capacity")).withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    packed = each.where(F.col("rest") > 0).groupBy("capacity", "block").applyInPandas(_pack_block, ASSIGNED)
    whole = each.where(F.col("n") >= F.col("capacity")).withColumn("piece", F.explode(F.sequence(F.lit(0), (F.floor(F.col("n") / F.col("capacity")) - 1).cast("int"))))
    whole = whole.select("capacity", F.concat(F.lit("d"), "uid", F.lit("-"), "piece").alias("container"), "doc_id", "piece", (F.col("piece") * F.col("capacity").cast("bigint")).alias("start_token"), F.col("capacity").cast("bigint").alias("tokens"))
    return packed.unionByName(whole)


def fill(assigned: DataFrame) -> DataFrame:
    """capacity, containers, tokens, used (share of the capacity), least (containers that no packing can do without)."""
    per = assigned.groupBy("capacity", "container").agg(F.sum("tokens").alias("t"))
    total = per.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return total.select("capacity", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("used"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least"))
