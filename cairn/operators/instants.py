"""Mixed timestamp formats and time zones to one instant (problem 4).

Local times are matched as of the zone's offset intervals: no matching interval means that the clock skipped the time,
two mean that it passed it twice, one gives the offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.times import ABBREVIATIONS, day_and_hour, fields, offset_minutes, parse_fields, part_texts, valid_micros

#: Years for which zone offsets are laid out; a wall clock outside them has no known offset and gives no instant.
FIRST_YEAR, LAST_YEAR = 1900, 2199
ZONE_ROWS = "zone string, year int, spans array<struct<lo: bigint, hi: bigint, offset: bigint>>"
_EPOCH = datetime(1970, 1, 1)


def zone_spans(name: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> list[tuple[int, int, int]]:
    """Intervals (local from, local before, offset) in seconds over which `name` keeps one offset; [] if unknown."""
    from zoneinfo import ZoneInfo

    try:
        zone = ZoneInfo(name)
    except Exception:  # not a zone, or no data for it
        return []
    offset = lambda t: int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())
    lo, end = (int((datetime(y, 1, 1) - _EPOCH).total_seconds()) for y in (first, last + 1))
    step, spans, start, now = 7 * 86400, [], lo, offset(lo)
    t = lo
    while t < end:
        u = min(t + step, end)
        if (then := offset(u)) != now:
            a, b = t, u
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if offset(mid) == now else (a, mid)
            spans.append((start + now, b + now, now))
            start, now, t = b, offset(b), b
        else:
            t = u
    spans.append((start + now, end + now, now))
    return spans


def _zone_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each zone and local year: every interval that touches the year or the day before or after it."""
    for batch in batches:
        rows = []
        for name in batch["zone"]:
            spans = zone_spans(name)
            for year in range(FIRST_YEAR, LAST_YEAR + 1) if spans else ():
                a, b = (int((datetime(y, 1, 1) - _EPOCH).total_seconds()) for y in (year, year + 1))
                rows.append((name, year, [{"lo": lo, "hi": hi, "offset": o} for lo, hi, o in spans if lo < b + 86400 and hi > a - 86400]))
        yield pd.DataFrame(rows, columns=["zone", "year", "spans"])


def zone_intervals(zones: DataFrame) -> DataFrame:
    """Offset intervals by zone and year of the zones in `zones` (column zone).

    One row per zone and year, so its size is bounded by the about 600 zones that exist, whatever the data: it may be broadcast.
    """
    return zones.select("zone").where(F.col("zone").isNotNull()).distinct().coalesce(4).mapInPandas(_zone_rows, ZONE_ROWS)


def normalise_times(values: DataFrame, clocks: DataFrame, text: str = "text", source: str = "source", out: str = "utc_micros") -> DataFrame:
    """`values` with `out`: the instant that `text` fixes, in micros since 1970, or null.

    clocks: source, zone_name, day_first, one row per source (fixed and small: the wall clocks of the sources).
    An offset, zone or abbreviation in the value holds over the source's clock; a zone name with an offset gives the
    offset. Dates with slashes need the source's day_first, all else is read without it. Null, empty and wordy texts,
    impossible dates, year 1's zero time, wall clocks of unknown zone and those that the zone skips or passes
    twice give null. A date alone is its first instant on its clock: the end of the gap if midnight is skipped, the
    first of two midnights. Rows are kept one to one, extra columns too. Empty tables give empty results.

    No shuffle of `values`: the clocks are few and Spark broadcasts them by their size, the zone intervals have a bounded size and are broadcast.
    """
    c = clocks.dropDuplicates(["source"]).select(F.col("source").alias("_source"), F.col("zone_name").alias("_home"), F.col("day_first").alias("_day_first"))
    named = F.regexp_extract(F.col(text), r"([A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)\]?\s*$", 1)
    zones = clocks.select(F.col("zone_name").alias("zone")).unionByName(values.select(named.alias("zone")).where(F.col("zone") != "").distinct())
    spans = F.broadcast(zone_intervals(zones).select(F.col("zone").alias("_z"), F.col("year").alias("_zy"), F.col("spans").alias("_spans")))

    base = values.join(c, F.col(source) == F.col("_source"), "left").withColumn("_p", parse_fields(F.col(text), F.col("_day_first")))
    texts = part_texts(F.col("_p"))
    base = base.withColumns({f"_{k}": v for k, v in texts.items()})
    made = fields({k: F.col(f"_{k}") for k in texts})
    base = base.withColumns({f"_f_{k}": v for k, v in made.items()})
    f = {k: F.col(f"_f_{k}") for k in made}
    more = day_and_hour(f)
    base = base.withColumns({f"_f_{k}": v for k, v in more.items()})
    f |= {k: F.col(f"_f_{k}") for k in more}
    base = base.withColumn("_local", valid_micros(f)).withColumn("_off", offset_minutes(f))
    known = F.lower(F.coalesce(f["zone"], F.lit(""))).isin(list(ABBREVIATIONS))
    zone = F.when(f["off"].isNotNull() | known, None).otherwise(F.coalesce(f["zone"], F.col("_home")))
    base = base.withColumn("_zone", F.when(F.col("_local").isNotNull(), zone))
    base = base.join(spans, (F.col("_zone") == F.col("_z")) & (f["y"] == F.col("_zy")), "left")
    sec = F.floor(F.col("_local") / 1000000)
    hits = F.filter("_spans", lambda x: (x["lo"] <= sec) & (sec < x["hi"]))
    later = F.filter("_spans", lambda x: x["lo"] > sec)
    date_only = f["h"].isNull()
    wall = (
        F.when(F.size(hits) == 1, F.col("_local") - F.element_at(hits, 1)["offset"] * 1000000)
        .when(date_only & (F.size(hits) == 2), F.array_min(F.transform(hits, lambda x: F.col("_local") - x["offset"] * 1000000)))
        .when(date_only & (F.size(hits) == 0) & (F.size(later) > 0), F.array_min(F.transform(later, lambda x: (x["lo"] - x["offset"]) * 1000000)))
    )
    value = F.when(f["instant"].isNotNull(), f["instant"]).when(F.col("_off").isNotNull(), F.col("_local") - F.col("_off").cast("bigint") * 60000000).when(f["off"].isNotNull(), None).otherwise(wall)
    return base.withColumn(out, value).drop("_source", "_home", "_day_first", "_p", *[f"_{k}" for k in texts], *[f"_f_{k}" for k in f], "_local", "_off", "_zone", "_z", "_zy", "_spans")


def time_values(memories: DataFrame, goals: DataFrame, timeline: DataFrame) -> DataFrame:
    """src, row_id, text and source of every timestamp text of the three tables."""
    parts = [
        memories.select(F.lit("memories.timestamp").alias("src"), F.col("seq").alias("row_id"), F.col("value.timestamp").alias("text"), F.col("value.source").alias("source")),
        goals.select(F.lit("goals.deadline").alias("src"), F.col("seq").alias("row_id"), F.col("deadline").alias("text"), "source"),
        goals.select(F.lit("goals.created_at").alias("src"), F.col("seq").alias("row_id"), F.col("created_at").alias("text"), "source"),
        timeline.select(F.lit("timeline_events.created_at").alias("src"), F.col("id").alias("row_id"), F.col("created_at").alias("text"), "source"),
    ]
    return reduce(DataFrame.unionByName, parts)
