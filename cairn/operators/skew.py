"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one part in so many of the rows: there are fewer hot keys than this, whatever the data.
PARTS = 1024
#: Keys of so few rows are never hot.
FEW = 1000


def hot_keys(rows: DataFrame, key: str, parts: int = PARTS, few: int = FEW) -> DataFrame:
    """_hot, _parts: every key of more than `few` rows that holds more than one part in `parts` of them, and over how many salts to spread it so that none holds more.

    Counted over all rows, pre-aggregated in the tasks that read them. There are fewer than `parts` such keys, so the table may be broadcast. Null keys are none.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    share = F.col("_n") * parts
    return counts.crossJoin(F.broadcast(total)).where((F.col("_n") > few) & (share > F.col("_all"))).select(F.col(key).alias("_hot"), (F.ceil(share / F.col("_all")) + 1).cast("int").alias("_parts"))


def salted_lookup(facts: DataFrame, dim: DataFrame, key: str, row: Column, how: str = "left", parts: int = PARTS, few: int = FEW) -> DataFrame:
    """`facts` joined (`how`: left or inner) to `dim` without a hot partition.

    Rows of a hot key (see hot_keys) are spread over as many salts as its share asks for, by a hash of `row` (deterministic,
    so a lost task gives the same rows again); `dim` rows of that key are repeated for each salt, all others stand once.
    Null keys join nothing; a left join keeps them. `dim` columns other than `key` must not occur in `facts`.
    """
    hot = F.broadcast(hot_keys(facts, key, parts, few))
    left = facts.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(row), F.col("_parts")).cast("int")).otherwise(F.lit(0))
    ).drop("_hot", "_parts")
    right = (
        dim.join(hot, F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_hot", "_parts")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")
