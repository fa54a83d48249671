"""References to records that do not exist (problem 3).

A reference is a tuple of columns that should equal the key columns of another table. Any of its columns may be
null, so references are grouped by their null mask and each mask is matched on its own non-null columns only.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.skew import salted_lookup

MATCHES = ("simple", "partial", "full")


def normal_goal_ref(ref: Column) -> Column:
    """A goal reference without blanks, case, closing slash and mirror prefix; null where nothing is left."""
    r = F.lower(F.regexp_replace(ref, r"(?U)^\s+|\s+$", ""))
    r = F.regexp_replace(r, r"^memory/goals/[^/]*/", "")
    r = F.regexp_replace(r, r"(?U)/$|^\s+|\s+$", "")
    return F.nullif(r, F.lit(""))


def key_states(targets: DataFrame, keys: Sequence[str], at: str, deleted: str | None) -> DataFrame:
    """Per key of a version log: when it first arrived, and when it was first deleted (null: never)."""
    gone = F.min(F.when(F.col(deleted), F.col(at))) if deleted else F.lit(None).cast("timestamp")
    return targets.groupBy(*keys).agg(F.min(at).alias("first_at"), gone.alias("gone_at"))


def broken_references(refs: DataFrame, targets: DataFrame, ref_cols: Sequence[str], key_cols: Sequence[str], row: str, ref_at: str, target_at: str, deleted: str | None = None, match: str = "simple") -> DataFrame:
    """Rows of `refs` whose reference has no live target, with `kind` missing, late or deleted.

    refs: has `row` (unique), `ref_at` (timestamp) and `ref_cols`; targets: a version log with `key_cols`, `target_at`
    and optionally a boolean `deleted`. Columns of both may clash; only those named here are used.
    match, as in SQL's foreign keys, says what a reference with some null columns means:
      simple   a reference with any null column refers to nothing and is never broken;
      partial  the non-null columns must occur together in some target;
      full     a reference with some but not all columns null is broken (missing).
    References whose columns are all null refer to nothing under every match.
    kind: `missing` if no target ever has the key, `deleted` if a deletion of it is no later than the reference,
    `late` if the first target arrives after the reference; deleted goes before late. A null `ref_at` can only be
    missing. Empty refs give no rows; empty targets make every reference missing. Repeated rows count each.

    Every mask's join is a salted lookup against one aggregated row per key, so neither a key that holds a third of
    the references nor one with many versions makes a hot task.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    n = len(ref_cols)
    src = refs.select(F.col(row).alias("_row"), F.col(ref_at).alias("_at"), *[F.col(c).alias(f"_r{i}") for i, c in enumerate(ref_cols)])
    tgt = targets.select(F.col(target_at).alias("_t"), (F.col(deleted) if deleted else F.lit(False)).alias("_d"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key_cols)])
    mask = F.concat(*[F.when(F.col(f"_r{i}").isNull(), "0").otherwise("1") for i in range(n)])
    src = src.withColumn("_mask", mask)
    parts = []
    for bits in product("01", repeat=n):
        m = "".join(bits)
        if "1" not in m or ("0" in m and match == "simple"):
            continue
        mine = src.where(F.col("_mask") == m)
        if "0" in m and match == "full":
            parts.append(mine.select("_row", F.lit("missing").alias("kind")))
            continue
        on = [i for i, b in enumerate(bits) if b == "1"]
        keyed = tgt.where(F.greatest(*[F.col(f"_k{i}").isNull().cast("int") for i in on], F.lit(0)) == 0)
        states = key_states(keyed, [f"_k{i}" for i in on], "_t", "_d")
        if len(on) == 1:
            left, right = mine.withColumn("_key", F.col(f"_r{on[0]}").cast("string")), states.withColumn("_key", F.col(f"_k{on[0]}").cast("string"))
        else:
            left = mine.withColumn("_key", F.to_json(F.array(*[F.col(f"_r{i}").cast("string") for i in on])))
            right = states.withColumn("_key", F.to_json(F.array(*[F.col(f"_k{i}").cast("string") for i in on])))
        met = salted_lookup(left.select("_key", "_row", "_at"), right.select("_key", F.lit(True).alias("_there"), "first_at", "gone_at"), "_key", F.col("_row"))
        kind = (
            F.when(F.col("_there").isNull(), "missing")
            .when(F.col("gone_at") <= F.col("_at"), "deleted")
            .when(F.col("first_at") > F.col("_at"), "late")
        )
        parts.append(met.select("_row", kind.alias("kind")).where(F.col("kind").isNotNull()))
    if not parts:
        return src.select("_row", F.lit("missing").alias("kind")).where(F.lit(False)).withColumnRenamed("_row", row)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("_row", row)


def broken_goal_references(memories: DataFrame, commands: DataFrame, goals: DataFrame) -> DataFrame:
    """src, row_id, received_at and kind of every broken goal reference of memories and agent commands."""
    refs = memories.select(F.lit("memories").alias("src"), F.col("seq").alias("id"), normal_goal_ref(F.col("value.goal_id")).alias("ref"), "received_at").unionByName(
        commands.select(F.lit("agent_commands").alias("src"), F.col("command_id").alias("id"), normal_goal_ref(F.col("goal_id")).alias("ref"), "received_at")
    )
    refs = refs.where(F.col("ref").isNotNull()).withColumn("row", F.struct("src", F.col("id").alias("row_id"), "received_at"))
    targets = goals.select(normal_goal_ref(F.col("id")).alias("key"), F.coalesce("deleted", F.lit(False)).alias("deleted"), F.col("received_at").alias("target_at"))
    out = broken_references(refs, targets, ["ref"], ["key"], "row", "received_at", "target_at", "deleted")
    return out.select("row.src", "row.row_id", "row.received_at", "kind")


def broken_by_period(broken: DataFrame) -> DataFrame:
    """Counts of broken references per table, month of arrival and kind."""
    return broken.groupBy("src", F.date_format("received_at", "yyyy-MM").alias("month"), "kind").agg(F.count("*").alias("n"))
