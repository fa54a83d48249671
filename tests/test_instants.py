from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from cairn.operators.instants import normalise_times, zone_spans

CLOCKS = [("mos", "Europe/Moscow", True), ("ny", "America/New_York", False), ("utc", "UTC", True), ("none", None, True), ("sp", "America/Sao_Paulo", True)]


def micros(*a, tz=timezone.utc):
    return round(datetime(*a, tzinfo=tz).timestamp()) * 1_000_000


def run(spark, rows):
    clocks = spark.createDataFrame(CLOCKS, "source string, zone_name string, day_first boolean")
    values = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "id int, text string, source string, zone_name string")
    return [r["utc_micros"] for r in normalise_times(values, clocks).orderBy("id").collect()]


def test_forms(spark):
    mos, ny = ZoneInfo("Europe/Moscow"), ZoneInfo("America/New_York")
    cases = [
        (("2026-01-02T03:04:05Z", None), micros(2026, 1, 2, 3, 4, 5)),
        (("\t2026-01-02t03:04:05z ", "x"), micros(2026, 1, 2, 3, 4, 5)),
        (("2026-01-02 03:04:05,250", "mos"), micros(2026, 1, 2, 3, 4, 5, tz=mos) + 250_000),
        (("2026-01-02T03:04:05.123456789+05:30", None), micros(2026, 1, 1, 21, 34, 5) + 123_456),
        (("2026-01-02 03:04:05 -0600", "mos"), micros(2026, 1, 2, 9, 4, 5)),
        (("2026-07-02 03:04:05 CEST", None), micros(2026, 7, 2, 1, 4, 5)),
        (("2026-07-02T03:04:05[America/New_York]", "mos"), micros(2026, 7, 2, 3, 4, 5, tz=ny)),
        (("2026-07-02 03:04:05 America/New_York", "mos"), micros(2026, 7, 2, 3, 4, 5, tz=ny)),
        (("20260102T030405Z", None), micros(2026, 1, 2, 3, 4, 5)),
        (("20260102", "mos"), micros(2026, 1, 2, tz=mos)),
        (("1736484875", None), 1736484875_000_000),
        (("1736484875.786", None), 1736484875_786_000),
        (("1735989761023", None), 1735989761_023_000),
        (("1736086780981715", None), 1736086780_981_715),
        (("03/04/2026 05:06 PM", "mos"), micros(2026, 4, 3, 17, 6, tz=mos)),
        (("03/04/2026 12:06 AM", "ny"), micros(2026, 3, 4, 0, 6, tz=ny)),
        (("03.04.26 05:06", "ny"), micros(2026, 4, 3, 5, 6, tz=ny)),
        (("Fri, 02 Jan 2026 15:20:16 GMT", None), micros(2026, 1, 2, 15, 20, 16)),
        (("Apr 4, 2026 06:39 AM", "utc"), micros(2026, 4, 4, 6, 39)),
        (("10. März 2025 05:50", "utc"), micros(2025, 3, 10, 5, 50)),
        (("10 июня 2025 г., 17:22", "mos"), micros(2025, 6, 10, 17, 22, tz=mos)),
        (("5 September 2026", "utc"), micros(2026, 9, 5)),
        (("2018-11-04", "sp"), micros(2018, 11, 4, 3)),  # midnight is skipped: the day's first instant
        (("2018-02-18", "sp"), micros(2018, 2, 18, 3)),
    ]
    assert run(spark, [c[0] for c in cases]) == [c[1] for c in cases]


def test_none(spark):
    rows = [
        (None, "utc"), ("", "utc"), ("soon", "utc"), ("2026-02-30T10:00:00Z", "utc"), ("2025-13-04 08:00:00", "utc"), ("25:61", "utc"), ("31/31/2026", "mos"), ("0001-01-01T00:00:00Z", "utc"),
        ("0000-00-00 00:00:00", "utc"), ("2026-01-02 03:04:05", None), ("2026-01-02 03:04:05", "none"), ("03/04/2026", None), ("2026-03-08 02:30:00", "ny"), ("2026-11-01 01:30:00", "ny"),
        ("13:00 PM 2026", "utc"), ("Q4 2026", "utc"), ("2026-01-02 03:04:05 Mars/Base", "utc"), ("x" * 100_000, "utc"), ("a|b|c", "utc"), ("2026-01-02 13:04 PM", "utc"),
    ]
    assert run(spark, rows) == [None] * len(rows)
    assert run(spark, []) == []


def test_spans_agree_with_the_zone_hour_by_hour():
    zone = ZoneInfo("America/New_York")
    spans = zone_spans("America/New_York", 2025, 2026)
    for h in range(0, 24 * 365, 5):
        t = datetime(2025, 1, 1) + timedelta(hours=h)
        s = (t - datetime(1970, 1, 1)).total_seconds()
        wanted = {zone.utcoffset(t.replace(fold=f)).total_seconds() for f in (0, 1)}
        back = {o for o in wanted if (t - timedelta(seconds=o)).replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None) == t}
        assert {o for lo, hi, o in spans if lo <= s < hi} == back
    assert zone_spans("No/Where") == []


def test_random_times_in_random_forms(spark):
    import random

    g = random.Random(7)
    clocks = {"mos": "Europe/Moscow", "ny": "America/New_York", "utc": "UTC"}
    rows, wanted = [], []
    for _ in range(400):
        source = g.choice(list(clocks))
        zone = ZoneInfo(clocks[source])
        t = datetime(2025, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=g.randrange(700 * 86400))
        wall = t.astimezone(zone).replace(tzinfo=None)
        day_first = source != "ny"
        form = g.choice(["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d.%m.%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S" if day_first else "%m/%d/%Y %H:%M:%S", "%b %d, %Y %I:%M %p", "%d %B %Y %H:%M"])
        text = wall.strftime(form)
        read = datetime.strptime(text, form)
        back = {(read.replace(tzinfo=zone, fold=f)).astimezone(timezone.utc) for f in (0, 1)}
        fits = {b for b in back if b.astimezone(zone).replace(tzinfo=None) == read}
        rows.append((text, source))
        wanted.append(round(fits.pop().timestamp()) * 1_000_000 if len(fits) == 1 else None)
    assert run(spark, rows) == wanted
