"""Scenes: what was stored around the matches of a keyword, ranked by other keywords."""

from __future__ import annotations

import shlex

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.durations import delta_text, window_seconds
from cairn.operators.search import find


def in_window(points: DataFrame, rows: DataFrame, seconds: float, at: str = "at", time: str = "created_at") -> DataFrame:
    """Points joined to the rows at most `seconds` away from them, both bounds included.

    A range join as an equi-join: time is cut in buckets as wide as the window, each point goes to its own and the two next to it.
    `points` and `rows` must not share column names.
    """
    width = max(1.0, seconds)
    bucket = lambda c: F.floor(F.col(c).cast("double") / width).cast("bigint")
    spread = points.withColumn("_b", F.explode(F.sequence(bucket(at) - 1, bucket(at) + 1)))
    near = F.abs(F.col(time).cast("double") - F.col(at).cast("double")) <= seconds
    return spread.join(rows.withColumn("_b", bucket(time)), "_b").where(near).drop("_b")


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Which keywords the text holds, in their order, letters of any alphabet in any case; empty ones are skipped."""
    low = F.lower(text)
    hits = [F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in dict.fromkeys(keywords) if k]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def relevance(hits: Column) -> Column:
    return F.least(F.lit(100), F.lit(50) + F.size(hits) * 25)


def around(kv: DataFrame, query: str, keywords: list[str], window: str = "", most: int = 10) -> DataFrame:
    """match_key, match_at, key, value, created_at, delta (seconds), own, hits of what lies around the first `most` matches by key.

    Of each match the earliest 2 * most rows of its window, times compared to the second. The match itself lies in its window and takes one of
    these places, but is no entry: `own` marks it. So every match has a row here, and the values are read twice in all, once for the matches.
    """
    points = find(kv, query, most).select(F.col("key").alias("match_key"), F.col("created_at").alias("match_at"))
    rows = in_window(points, kv.select("key", "value", "created_at"), max(0.0, window_seconds(window)), "match_at")
    order = Window.partitionBy("match_key").orderBy("created_at", "key")
    kept = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 2 * most)
    delta = F.unix_timestamp("created_at") - F.unix_timestamp("match_at")
    return kept.select("match_key", "match_at", "key", "value", "created_at", delta.alias("delta"), (F.col("key") == F.col("match_key")).alias("own"), keyword_hits(F.concat("key", F.lit(" "), "value"), keywords).alias("hits"))


def entries(kv: DataFrame, query: str, keywords: list[str], window: str = "", most: int = 10) -> DataFrame:
    """match_key, relevance, side (before or after), key, delta of every entry of every scene."""
    s = scenes(kv, query, keywords, window, most)
    named = lambda side: F.transform(side, lambda e: F.struct(F.lit(side).alias("side"), e["key"].alias("key"), e["delta"].alias("delta")))
    return s.select("match_key", "relevance", F.explode(F.concat(named("before"), named("after"))).alias("e")).select("match_key", "relevance", "e.side", "e.key", "e.delta")


def scenes(kv: DataFrame, query: str, keywords: list[str], window: str = "", most: int = 10) -> DataFrame:
    """match_key, match_at, relevance, keywords, before, after (arrays of created_at, key, delta in order of time), by relevance, then key.

    relevance is 50, and 25 more for each keyword that some entry holds, 100 at most. An entry at the match's own second comes after it.
    """
    e = around(kv, query, keywords, window, most)
    item = F.struct("created_at", "key", delta_text(F.col("delta")).alias("delta"))
    side = lambda cond: F.array_sort(F.collect_list(F.when(cond & ~F.col("own"), item)))
    none = F.array().cast("array<string>")
    got = e.groupBy("match_key", "match_at").agg(
        F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("own"), F.col("hits")).otherwise(none)))).alias("_k"), side(F.col("delta") < 0).alias("before"), side(F.col("delta") >= 0).alias("after")
    )
    asked = F.array(*[F.lit(k) for k in dict.fromkeys(keywords) if k]) if any(keywords) else none
    got = got.withColumn("keywords", F.filter(asked, lambda k: F.array_contains("_k", k)))
    return got.select("match_key", "match_at", relevance(F.col("keywords")).alias("relevance"), "keywords", "before", "after").orderBy(F.desc("relevance"), "match_key").limit(most)


def arguments(text: str) -> dict:
    """query, keywords, window and limit of a line like `backup plan --keywords graph,queue --window 2h --max 5`; options may also be written with =, words may be quoted.

    ValueError for an unknown option, one without a value, a limit that is no number, or quotes that are not closed.
    """
    out: dict = {"query": "", "keywords": [], "window": "", "limit": 10}
    words, parts = [], shlex.split(text)
    while parts:
        part = parts.pop(0)
        if not part.startswith("--"):
            words.append(part)
            continue
        name, eq, value = part[2:].partition("=")
        if name not in ("keywords", "window", "max") or not (eq or parts):
            raise ValueError(f"what is {part}?")
        value = value if eq else parts.pop(0)
        out |= {"keywords": [k for k in value.split(",") if k]} if name == "keywords" else {"window": value} if name == "window" else {"limit": int(value)}
    return out | {"query": " ".join(words)}
