"""Parsing of date and time texts into calendar fields, offset or zone name, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names by number, as lower-case beginnings that are distinct over en, de, fr, es, pt, ru and uk.
MONTHS = {
    1: ("jan", "jän", "ene", "янв", "січ"),
    2: ("feb", "fév", "fev", "фев", "лют"),
    3: ("mar", "mär", "mrz", "мар", "бер"),
    4: ("apr", "avr", "abr", "апр", "кві"),
    5: ("may", "mai", "мая", "май", "тра"),
    6: ("jun", "juin", "июн", "чер"),
    7: ("jul", "juil", "июл", "лип"),
    8: ("aug", "aoû", "aou", "ago", "авг", "сер"),
    9: ("sep", "set", "сен", "вер"),
    10: ("oct", "okt", "out", "окт", "жов"),
    11: ("nov", "ноя", "лис"),
    12: ("dec", "dez", "déc", "dic", "дек", "гру"),
}
#: Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180,
    "msk": 180, "ist": 330, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "jst": 540,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,18}))?)?(?:\s?([AaPp])\.?[Mm]\b\.?)?"
_ZONE = r"(?:\s?([+-]\d{2}:?\d{2}|[+-]\d{2}))?(?:\s?\[?([A-Za-z]{1,5}|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)\]?)?"
_TAIL = rf"(?:,?[Tt\s]\s?{_TIME}{_ZONE})?$"
ISO = rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_TAIL}"
SLASH = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}){_TAIL}"
DOT = rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}){_TAIL}"
DASH = rf"^(\d{{1,2}})-(\d{{1,2}})-(\d{{4}}){_TAIL}"
COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:[Tt](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,18}))?)?()" + _ZONE + ")?$"
DAY_NAME = rf"^(?:\p{{L}}{{2,12}}\.?,?\s)?(\d{{1,2}})\.?\s(?:de\s)?(\p{{L}}{{3,12}})\.?,?\s(?:de\s)?(\d{{4}})(?:\s?г\.|\s?р\.)?{_TAIL}"
NAME_DAY = rf"^(?:\p{{L}}{{2,12}}\.?,?\s)?(\p{{L}}{{3,12}})\.?\s(\d{{1,2}})(?:st|nd|rd|th)?,?\s(\d{{4}}){_TAIL}"
NUMBER = r"^(\d{9,20})(?:\.(\d{1,18}))?$"


#: 0001-01-01T00:00:00 in seconds since 1970: the zero time of some languages, which means that no time was set.
YEAR_ONE = -62135596800


def month_number(name: Column) -> Column:
    n = F.lower(name)
    table = F.create_map(*[F.lit(x) for number, starts in MONTHS.items() for s in starts for x in (s, number)])
    return F.coalesce(F.try_element_at(table, F.coalesce(F.substring(n, 1, 4), F.lit(""))), F.try_element_at(table, F.coalesce(F.substring(n, 1, 3), F.lit(""))))


def _rest(first: int) -> str:
    """Replacement text of the seven groups from hour to zone, the hour being group `first`."""
    return "".join(f"|${k}" for k in range(first, first + 7))


def _year(text: Column) -> Column:
    y = text.try_cast("int")
    return F.when(F.length(text) > 2, y).when(y < 70, y + 2000).otherwise(y + 1900)


def parse_fields(text: Column, day_first: Column) -> Column:
    """Parts of a date or time text, null where no form fits; fields() makes columns of them.

    The fields are y, m, d, h, mi, s, us (micros; further digits cut), ap (a or p of a 12-hour clock), off (offset text), zone
    (name or abbreviation), instant (micros since 1970, only of numbers). Blanks around and repeated inside do not count.
    Dates with slashes follow `day_first` (null: no date), dates with dots are day first. Digits of 8 are a calendar
    date; 9 to 11 are seconds, 12 to 14 millis, 15 to 17 micros, 18 to 20 nanos since 1970, fractions of them counted.
    """
    s = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    s = F.when(~s.contains("|"), s)
    # Each form that fits turns the text into y|m|d|h|mi|s|fraction|ap|offset|zone, which no later form fits.
    s = F.regexp_replace(s, ISO, "$1|$3|$4" + _rest(5))
    s = F.regexp_replace(s, COMPACT, "$1|$2|$3" + _rest(4))
    s = F.regexp_replace(s, NUMBER, "n|$1|$2")
    s = F.when(day_first, F.regexp_replace(s, SLASH, "$3|$2|$1" + _rest(4))).when(~day_first, F.regexp_replace(s, SLASH, "$3|$1|$2" + _rest(4))).otherwise(s)
    s = F.regexp_replace(s, DOT, "$3|$2|$1" + _rest(4))
    s = F.when(day_first, F.regexp_replace(s, DASH, "$3|$2|$1" + _rest(4))).when(~day_first, F.regexp_replace(s, DASH, "$3|$1|$2" + _rest(4))).otherwise(s)
    s = F.regexp_replace(s, DAY_NAME, "$3|$2|$1" + _rest(4))
    s = F.regexp_replace(s, NAME_DAY, "$3|$1|$2" + _rest(4))
    return F.when(s.contains("|"), F.split(s, r"\|"))


#: Names of the texts that parse_fields' parts give, in their order; of numbers only the first two have a meaning: n, digits, fraction.
PARTS = ("p_y", "p_m", "p_d", "p_h", "p_mi", "p_s", "p_us", "p_ap", "p_off", "p_zone")


def part_texts(parts: Column) -> dict[str, Column]:
    return {name: F.nullif(F.try_element_at(parts, F.lit(k + 1)), F.lit("")) for k, name in enumerate(PARTS)}


def fields(p: dict[str, Column]) -> dict[str, Column]:
    """Numbers of the part texts. Keep them as columns of their own: a struct of them would be taken apart and repeated by the optimizer."""
    number = p["p_y"] == "n"
    n = F.length(p["p_m"])
    # Digits after the unit's point, so that the value in micros is its first n + 6 - scale digits.
    scale = F.when(n <= 11, 0).when(n <= 14, 3).when(n <= 17, 6).otherwise(9)
    instant = F.substring(F.concat(p["p_m"], F.rpad(F.coalesce(p["p_d"], F.lit("")), 6, "0")), F.lit(1), n + 6 - scale).try_cast("bigint")
    return {
        "y": _year(p["p_y"]), "m": F.coalesce(p["p_m"].try_cast("int"), month_number(p["p_m"])), "d": p["p_d"].try_cast("int"), "h": p["p_h"].try_cast("int"), "mi": p["p_mi"].try_cast("int"), "s": p["p_s"].try_cast("int"),
        "us": F.substring(F.rpad(p["p_us"], 6, "0"), 1, 6).try_cast("int"), "ap": F.lower(p["p_ap"]), "off": p["p_off"], "zone": p["p_zone"], "instant": F.when(number, instant),
    }


def day_and_hour(f: dict[str, Column]) -> dict[str, Column]:
    """days: since 1970, null for impossible dates; h24: the hour, 99 if a 12-hour clock has no such hour."""
    text = F.concat_ws("-", F.lpad(f["y"].cast("string"), 4, "0"), F.lpad(f["m"].cast("string"), 2, "0"), F.lpad(f["d"].cast("string"), 2, "0"))
    h = F.coalesce(f["h"], F.lit(0))
    h24 = F.when(f["ap"].isNull(), h).when(~h.between(1, 12), F.lit(99)).when(f["ap"] == "p", h % 12 + 12).otherwise(h % 12)
    return {"days": F.when(f["m"].isNotNull() & f["d"].isNotNull(), F.unix_date(text.try_cast("date"))).cast("bigint"), "h24": h24}


def valid_micros(f: dict[str, Column]) -> Column:
    """Micros on the value's own clock, null for impossible dates and times and for the zero time of year 1; needs day_and_hour's columns."""
    mi, s, us = (F.coalesce(f[c], F.lit(0)) for c in ("mi", "s", "us"))
    seconds = f["days"] * 86400 + f["h24"] * 3600 + mi * 60 + s
    return F.when((f["h24"] <= 23) & (mi <= 59) & (s <= 59) & (f["y"] >= 1) & (seconds != YEAR_ONE), seconds * 1000000 + us)


def offset_minutes(f: dict[str, Column]) -> Column:
    """The offset that the value itself fixes: its numeric offset, else its abbreviation's; null otherwise."""
    off = F.regexp_replace(f["off"], ":", "")
    hours, minutes = F.substring(off, 2, 2).cast("int"), F.coalesce(F.nullif(F.substring(off, 4, 2), F.lit("")).cast("int"), F.lit(0))
    numeric = F.when((hours <= 18) & (minutes <= 59), F.when(off.startswith("-"), -(hours * 60 + minutes)).otherwise(hours * 60 + minutes))
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.when(f["off"].isNotNull(), numeric).otherwise(F.try_element_at(table, F.lower(F.coalesce(f["zone"], F.lit("")))))
