"""Lines for people to read, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import cut, escape_html, labels_text, progress_bar, status_icon


def short(text: Column, most: int) -> Column:
    """A key or id of at most `most` characters, the last three dots where it is longer."""
    return cut(text, most, "...", most - 3)


def percent(share: Column) -> Column:
    return F.format_string("%.0f%%", share * 100)


def goal_line(ident: Column, title: Column, status: Column, priority: Column, progress: Column) -> Column:
    """▶ id  P5 [█████░░░░░]  50% title"""
    return F.concat(status_icon(status), F.lit(" "), F.rpad(short(ident, 24), 24, " "), F.lit(" P"), priority.cast("string"), F.lit(" ["), progress_bar(progress), F.lit("] "), F.lpad(progress.cast("string"), 3, " "), F.lit("% "), cut(F.coalesce(title, F.lit("")), 40, "…", 39))


def goal_card(title: Column, description: Column, labels: Column, deadline: Column, progress: Column) -> Column:
    """A goal as HTML text, cut to 4000 characters."""
    none = F.lit("")
    body = F.concat(
        F.lit("<b>"), escape_html(F.coalesce(title, none)), F.lit("</b> "), progress.cast("string"), F.lit("%\n"), escape_html(F.coalesce(description, none)), F.lit("\n"),
        escape_html(labels_text(labels)), F.when(F.coalesce(deadline, none) != "", F.concat(F.lit("\n"), escape_html(deadline))).otherwise(""),
    )
    return cut(body, 4000, "\n...")


def hit_line(rank: Column, key: Column, score: Column, content: Column) -> Column:
    """1. key (87%): content"""
    return F.concat(rank.cast("string"), F.lit(". "), short(key, 40), F.lit(" ("), percent(score), F.lit("): "), cut(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " "), 60, "…", 59))


def time_text(seconds: Column) -> Column:
    """2026-01-02 03:04:05 of whole seconds since 1970, in the session's zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")
