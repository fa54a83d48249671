"""Text functions, all as column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The letters that a keyword's first letter is also tried in upper case for.
FIRST_LOWER = LOWER + "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
FIRST_UPPER = UPPER + "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"
#: The patterns of subtasks, and of keys with an equals sign in suggestions, with and without a closing quote.
SUBTASK = r"(?m)^\s*[-*+]\s+\[([ xX])\]"
QUOTED_EQUALS = r'"(description|title|type|summary)="([^"]*)"'
BARE_EQUALS = r'"(description|title|type|summary)=([^",}\]]+)'
SPACES = r"(?U)^\s+|\s+$"


def fold_ascii(text: Column) -> Column:
    """A to Z in lower case, all other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def folded(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def trim_all(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, SPACES, "")


def upper_first(text: str) -> str:
    """The text with its first letter in upper case if it is one of FIRST_LOWER; é or ü stay."""
    return text[:1].translate(str.maketrans(FIRST_LOWER, FIRST_UPPER)) + text[1:]


def keyword_patterns(keyword: str) -> list[str]:
    """Folded LIKE patterns of a keyword and of its form with a capital first letter; % and _ in it are wildcards."""
    return list(dict.fromkeys("%" + folded(v) + "%" for v in (keyword, upper_first(keyword))))


def like_any(text: Column, patterns: list[str]) -> Column:
    """Whether the ASCII-folded text matches any folded pattern; a backslash is an ordinary sign."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | fold_ascii(text).like(p.replace("\\", "\\\\"))
    return hit


def auto_key(text: Column, day: Column) -> Column:
    """memory/auto/<day>/<first 8 hex digits of the text's md5>."""
    return F.concat(F.lit("memory/auto/"), F.date_format(day, "yyyy-MM-dd"), F.lit("/"), F.substring(F.md5(text), 1, 8))


def cut(text: Column, length: int, mark: str = "…", keep: int | None = None) -> Column:
    """At most `length` characters of a longer text (or `keep`), then `mark`; shorter texts as they are."""
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length if keep is None else keep)), F.lit(mark))).otherwise(text)


def prompt_cap(text: Column, most: int = 4000) -> Column:
    """Texts of more than `most` characters cut to so many, with dots after them; others as they are."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&#38;")), F.lit("<"), F.lit("&#60;")), F.lit(">"), F.lit("&#62;"))


def clean_labels(labels: Column) -> Column:
    """Labels trimmed, without empty and repeated ones, first ones first; [] for null."""
    trimmed = F.transform(F.coalesce(labels, F.array().cast("array<string>")), trim_all)
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))


def stored_labels(text: Column) -> Column:
    """Labels of a JSON array text, cleaned; [] for anything else."""
    return clean_labels(F.from_json(text, "array<string>"))


def given_labels(text: Column) -> Column:
    """Labels of an argument: a JSON array if it starts with [ (null if it is bad JSON), else parts between commas."""
    t = trim_all(text)
    return F.when(t == "", F.array().cast("array<string>")).when(t.startswith("["), F.when(F.from_json(t, "array<string>").isNotNull(), stored_labels(t))).otherwise(clean_labels(F.split(t, ",")))


def loose_labels(raw: Column) -> Column:
    """Labels of raw JSON: an array, a string that holds an array, a string with commas, or a bare text with commas."""
    inner = F.get_json_object(F.concat(F.lit('{"x":'), raw, F.lit("}")), "$.x")
    is_text = trim_all(raw).startswith('"')
    direct = F.when(~is_text, F.from_json(raw, "array<string>"))
    parts = F.filter(F.transform(F.split(F.regexp_replace(raw, r'^["\[\] ]+|["\[\] ]+$', ""), ","), trim_all), lambda x: x != "")
    quoted = F.coalesce(F.from_json(F.when(is_text, inner), "array<string>"), F.when(is_text, F.filter(F.transform(F.split(inner, ","), trim_all), lambda x: x != "")))
    return F.coalesce(direct, quoted, parts)


def labels_text(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise(F.lit("—"))


def subtask_marks(description: Column) -> Column:
    """The marks (blank, x or X) of a description's list of tasks, in order."""
    return F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(SUBTASK), F.lit(1))


def subtask_progress(description: Column, otherwise: Column) -> Column:
    """Whole per cent of done subtasks; `otherwise` where there are none."""
    marks = subtask_marks(description)
    done = F.size(F.filter(marks, lambda m: F.lower(m) == "x"))
    return F.when(F.size(marks) > 0, F.floor(done * 100 / F.size(marks)).cast("int")).otherwise(otherwise)


def progress_bar(percent: Column, width: int = 10) -> Column:
    filled = F.least(F.lit(width), F.greatest(F.lit(0), F.floor(percent * width / 100).cast("int")))
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def status_icon(status: Column) -> Column:
    return F.when(status == "active", "▶").when(status == "completed", "✓").when(status == "archived", "▦").otherwise("○")


def repaired_json(text: Column) -> Column:
    """Keys of the suggestion form whose colon and quotes came out as an equals sign, put right: first with a closing quote, then without."""
    return F.regexp_replace(F.regexp_replace(text, QUOTED_EQUALS, '"$1":"$2"'), BARE_EQUALS, '"$1":"$2"')


def between(text: Column, left: str, right: str) -> Column:
    """From the first `left` to the last `right`, both included; null if there is no such part."""
    a = F.instr(text, left)
    b = F.length(text) - F.instr(F.reverse(text), right) + 1
    return F.when((a > 0) & (F.instr(text, right) > 0) & (b > a), F.substring(text, a, b - a + 1))


def reply_text(body: Column) -> Column:
    """The text of a model's answer: a message, a chat stream's line, or lines of such, whose parts are joined. Null if there is none."""
    paths = ("$.choices[0].message.content", "$.choices[0].delta.content", "$.message.content", "$.response")
    one = lambda t: F.coalesce(*[F.get_json_object(t, p) for p in paths])
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    parts = F.filter(F.transform(lines, one), lambda x: x.isNotNull())
    joined = F.when(F.size(parts) > 0, F.array_join(parts, ""))
    return F.when(F.size(lines) > 1, F.coalesce(joined, one(body))).otherwise(one(body))


def reply_error(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.error"))
