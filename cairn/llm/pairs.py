"""Items that appear together (problem 6).

Every basket becomes packed 64-bit codes, one per pair of its items. A task sorts its codes in runs of bounded
size and counts equal neighbours (the pre-aggregation), Spark's external sort merges the runs of all tasks, and the
merged runs are counted the same way. Odds ratios with a continuity correction follow from the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import shuffle_width

#: Codes held at once by a task before they are sorted, counted and passed on: 32 MB.
RUN = 1 << 22


def clean_items(items: Column) -> Column:
    """The set of items: trimmed, freed of leading #, lower-cased, without empty ones; null for a null array."""
    tidy = F.transform(items, lambda x: F.lower(F.regexp_replace(x, r"(?U)^[\s#]+|\s+$", "")))
    return F.array_distinct(F.filter(tidy, lambda x: x.isNotNull() & (x != "")))


def label_items(labels: Column) -> Column:
    """Items of a label text: a JSON array if it starts with [, else parts between commas. Bad JSON gives no items."""
    t = F.regexp_replace(labels, r"(?U)^\s+|\s+$", "")
    return F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.split(labels, ","))


def item_counts(baskets: DataFrame) -> DataFrame:
    """item, n: the baskets that hold the item; the item null stands for all baskets with any item."""
    held = baskets.where(F.size("items") > 0)
    return held.select(F.explode(F.concat("items", F.array(F.lit(None).cast("string")))).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def _runs(codes: np.ndarray, weights: np.ndarray | None = None) -> pa.RecordBatch:
    """Sorted distinct codes and how often each occurs."""
    order = np.argsort(codes, kind="stable") if weights is not None else None
    sorted_ = codes[order] if order is not None else np.sort(codes)
    if len(sorted_) == 0:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["code", "n"])
    starts = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1])
    n = np.add.reduceat(weights[order], starts) if weights is not None else np.diff(np.append(starts, len(sorted_)))
    return pa.RecordBatch.from_arrays([pa.array(sorted_[starts]), pa.array(n.astype(np.int64))], ["code", "n"])


def pack_pairs(ids: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Codes (smaller id << 32 | larger id) of all pairs of each basket ids[offsets[i]:offsets[i+1]] of distinct ids.

    Baskets of one size are handled together; codes come in arrays of about RUN at most, so a long basket's pairs
    are never all held at once.
    """
    sizes = np.diff(offsets)
    for k in np.unique(sizes[sizes > 1]):
        at = offsets[:-1][sizes == k]
        if k <= 512:
            i, j = np.triu_indices(k, 1)
            step = max(1, RUN // len(i))
            for s in range(0, len(at), step):
                block = np.sort(ids[at[s : s + step, None] + np.arange(k)], axis=1)
                yield ((block[:, i] << 32) | block[:, j]).ravel()
        else:
            for start in at:
                row = np.sort(ids[start : start + k])
                for x in range(k - 1):
                    yield (row[x] << 32) | row[x + 1 :]


def _pair_runs(names: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            ids = pc.index_in(flat, value_set=names)
            keep = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            owner = np.repeat(np.arange(len(lengths)), lengths)[keep]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(lengths)))])
            for codes in pack_pairs(np.asarray(ids.drop_null()).astype(np.int64), offsets):
                held.append(codes)
                size += len(codes)
                if size >= RUN:
                    yield _runs(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield _runs(np.concatenate(held))

    return run


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length sums of (code, n) rows that arrive sorted by code; a run may go on in the next batch."""
    last: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        out = _runs(np.asarray(batch.column(0)), np.asarray(batch.column(1)))
        code, n = np.asarray(out.column(0)), np.array(out.column(1))
        if last is not None:
            if code[0] == last[0]:
                n[0] += last[1]
            else:
                code, n = np.concatenate([[last[0]], code]), np.concatenate([[last[1]], n])
        last = (int(code[-1]), int(n[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(code[:-1]), pa.array(n[:-1])], ["code", "n"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], ["code", "n"])


def co_occurrence(baskets: DataFrame, min_count: int = 3, min_share: float = 0.001, min_lift: float = 0.0) -> DataFrame:
    """Pairs of items: item_a < item_b, n_a, n_b, n_ab, n, lift and log_odds.

    baskets: a column `items`, an array of distinct strings; extra columns do not matter. Baskets that are null or
    empty do not count; repeated rows count each. lift = n_ab * n / (n_a * n_b), kept at min_lift or more;
    log_odds is the log odds ratio of the 2x2 table with 0.5 added to each cell (defined when cells are 0).
    A pair is kept with n_ab >= min_count and n_ab >= n * min_share. Empty input gives no rows.

    Exact pruning before pairs are made: an item in fewer baskets than the smallest kept n_ab, or (min_lift > 1) in
    more than n / min_lift baskets, is in no kept pair. The kept items number at most mean basket size / min_share,
    whatever the input's size, and only they go to the tasks as a dictionary; with min_share 0 the bound is the number
    of distinct items.
    """
    counts = item_counts(baskets).cache()
    spark = baskets.sparkSession
    total = counts.where(F.col("item").isNull()).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    least = max(min_count, int(np.ceil(total * min_share - 1e-9)), 1)
    kept = counts.where(F.col("item").isNotNull() & (F.col("n") >= least))
    if min_lift > 1:
        kept = kept.where(F.col("n") * F.lit(float(min_lift)) <= total)
    rows = sorted((r["item"], r["n"]) for r in kept.collect())
    counts.unpersist()
    names = pa.array([r[0] for r in rows], pa.string())
    runs = baskets.where(F.size("items") > 1).select("items").mapInArrow(_pair_runs(names), "code bigint, n bigint")
    merged = runs.repartition(shuffle_width(spark), "code").sortWithinPartitions("code").mapInArrow(_merge_runs, "code bigint, n bigint")
    merged = merged.where(F.col("n") >= least)
    dic = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(rows)], "id long, item string, c long")
    a = F.broadcast(dic.select(F.col("id").alias("ia"), F.col("item").alias("item_a"), F.col("c").alias("n_a")))
    b = F.broadcast(dic.select(F.col("id").alias("ib"), F.col("item").alias("item_b"), F.col("c").alias("n_b")))
    n = F.lit(total).cast("bigint")
    both = (
        merged.select(F.shiftright("code", 32).alias("ia"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("ib"), F.col("n").alias("n_ab"))
        .join(a, "ia").join(b, "ib").withColumn("n", n)
    )
    # Integer cross-multiplication: no rounding decides a case.
    both = both.where(F.col("n_ab").cast("decimal(38,0)") * F.col("n") >= F.lit(min_lift).cast("decimal(12,4)") * F.col("n_a") * F.col("n_b")) if min_lift else both
    half = lambda x: x + F.lit(0.5)
    odds = half(F.col("n_ab")) * half(n - F.col("n_a") - F.col("n_b") + F.col("n_ab")) / (half(F.col("n_a") - F.col("n_ab")) * half(F.col("n_b") - F.col("n_ab")))
    return both.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n", (F.col("n_ab") * n / (F.col("n_a") * F.col("n_b"))).alias("lift"), F.log(odds).alias("log_odds"))


def tag_baskets(memories: DataFrame, goals: DataFrame) -> DataFrame:
    tags = memories.select(clean_items(F.col("value.tags")).alias("items"))
    return tags.unionByName(goals.select(clean_items(label_items(F.col("labels"))).alias("items")))
