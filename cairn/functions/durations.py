"""Windows of time as texts, and differences of times as texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of durations in seconds.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
DEFAULT = 7200.0
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def seconds(text: str) -> float | None:
    """Seconds of a duration like 30m, 1h30m, 500ms or 2d; two hours for an empty text, None for a bad one."""
    if text == "":
        return DEFAULT
    if text.endswith("d"):
        m = re.match(r"\s*([+-]?\d+)d", text)
        return float(m[1]) * 86400 if m else None
    body = text[1:] if text[0] in "+-" else text
    if body == "0":
        return 0.0
    parts = _PART.findall(body)
    if not parts or "".join(a + b for a, b in parts) != body:
        return None
    total = sum(float(a) * UNITS[b] for a, b in parts)
    return -total if text[0] == "-" else total


def window_seconds(text: str | None) -> float:
    """Seconds of a window; two hours where the text is bad."""
    found = seconds(text or "")
    return DEFAULT if found is None else found


def seconds_of(text: Column) -> Column:
    """The same as seconds(), as a column: null for a bad text and for null."""
    number, unit = r"\d+(?:\.\d*)?|\.\d+", "ns|us|µs|μs|ms|s|m|h"
    body = F.regexp_replace(text, r"^[+-]", "")
    found = lambda k: F.regexp_extract_all(body, F.lit(f"({number})({unit})"), F.lit(k))
    each = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    total = F.aggregate(F.zip_with(found(1), found(2), lambda n, u: n.cast("double") * F.element_at(each, u)), F.lit(0.0), lambda a, x: a + x)
    days = F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)d", 1), F.lit("")).cast("double") * 86400
    plain = F.when(body == "0", 0.0).when(body.rlike(f"^(?:(?:{number})(?:{unit}))+$"), F.when(text.startswith("-"), -total).otherwise(total))
    return F.when(text == "", F.lit(DEFAULT)).when(text.endswith("d"), days).otherwise(plain)


def whole_seconds(text: Column) -> Column:
    """Whole seconds of duration texts (1d, 2h, 1h30m, 1500ms), the rest cut; null for other texts."""
    return seconds_of(text).cast("bigint")


def delta_text(delta_seconds: Column) -> Column:
    """+1h5m, -20m, +0m: hours and minutes of a difference in whole seconds, the rest cut."""
    n = F.abs(delta_seconds)
    h, m = F.floor(n / 3600), F.floor(n / 60) % 60
    sign = F.when(delta_seconds < 0, "-").otherwise("+")
    return F.when(h > 0, F.concat(sign, h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m"))).otherwise(F.concat(sign, m.cast("string"), F.lit("m")))
