"""Rules that tell questions, commands, goals and notes apart, as column expressions.

The rules are tried in that order and know no word boundaries: a text that starts with the letters of a
question word is a question, whatever word they begin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import trim_all

#: Beginnings of questions.
QUESTION = [
    "что", "как", "где", "когда", "почему", "зачем", "кто", "чей", "сколько",
    "какой", "какая", "какие", "какое",
    "what", "how", "where", "when", "why", "who", "whose", "which", "whom",
    "расскажи", "напомни", "найди", "поищи",
    "tell me", "show me", "find", "search", "remind",
]
#: Phrases of commands, in the order in which they are tried.
COMMANDS = {
    "goals": ["покажи цели", "мои цели", "список целей", "какие цели", "активные цели", "все цели", "show goals", "my goals", "list goals", "active goals", "what goals"],
    "suggest": ["что делать", "чем заняться", "что дальше", "подскажи", "посоветуй", "следующие шаги", "what to do", "next steps", "suggest", "what next", "what now"],
    "context": ["покажи контекст", "какой контекст", "текущий контекст", "контекст", "show context", "what context", "current context"],
    "timeline": ["последние события", "что было", "лента", "недавнее", "история", "покажи события", "recent events", "what happened", "timeline", "recent activity", "history"],
    "digest": ["сводка за день", "сводка за неделю", "сводка за месяц", "итоги дня", "дайджест", "daily summary", "weekly summary", "monthly summary", "digest", "summary"],
    "search": ["найди", "поищи", "поиск", "напомни про", "что я знаю о", "search for", "find", "remind me about", "what do I know about"],
}
#: Beginnings of goals, and marks anywhere in them.
GOAL = [
    "хочу", "нужно", "надо", "необходимо", "планирую", "собираюсь",
    "задача", "цель", "todo", "to-do",
    "i want", "i need", "i will", "goal", "objective", "task",
    "сделать", "создать", "написать", "реализовать", "добавить",
    "make", "create", "implement", "add", "fix", "build",
]
GOAL_MARKS = ["цель:", "goal:"]
#: Words of high and of low priority; the high ones are looked for first.
HIGH = ["срочно", "важно", "критично", "немедленно", "asap", "urgent", "important", "high priority", "critical", "блокер"]
LOW = ["не срочно", "неважно", "low priority", "когда-нибудь", "потом", "некритично", "необязательно"]
#: Greetings.
GREETINGS = ["привет", "здравствуй", "здрасте", "даров", "ку", "хай", "hello", "hi", "hey", "good morning", "good evening", "help", "хелп", "что ты умеешь", "what can you do"]


def _any(hits: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, hits)


def _starts(low: Column, words: list[str]) -> Column:
    return _any([low.startswith(w) for w in words])


def is_question(text: Column) -> Column:
    return _starts(F.lower(text), QUESTION) | trim_all(text).endswith("?")


def command(text: Column) -> Column:
    """The name of the first command one of whose phrases starts the text or follows a blank; null if none does."""
    low = F.lower(text)
    out = None
    for name, words in COMMANDS.items():
        hit = _any([low.startswith(w) | low.contains(" " + w) | low.contains(", " + w) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def is_goal(text: Column) -> Column:
    low = F.lower(text)
    return _starts(low, GOAL) | _any([low.contains(w) for w in GOAL_MARKS])


def priority(text: Column) -> Column:
    low = F.lower(text)
    return F.when(_any([low.contains(w) for w in HIGH]), 9).when(_any([low.contains(w) for w in LOW]), 2).otherwise(5)


def title(text: Column) -> Column:
    """The first line of several, else the first 80 characters; of an empty first line the rest."""
    lines = F.split(text, "\n", 2)
    first = F.when(F.size(lines) > 1, trim_all(lines[0])).otherwise(F.left(text, F.lit(80)))
    return F.when(first == "", description(text)).otherwise(first)


def description(text: Column) -> Column:
    lines = F.split(text, "\n", 2)
    return F.when(F.size(lines) > 1, trim_all(F.try_element_at(lines, F.lit(2)))).otherwise(text)


def hashtags(text: Column) -> Column:
    """Words that start with #, without signs at their ends, lower-cased, each once, in order."""
    words = F.filter(F.split(trim_all(text), r"(?U)\s+"), lambda w: w.startswith("#") & (F.length(w) > 1))
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(F.substring(w, F.lit(2), F.length(w)), r"^[^\p{L}\p{Nd}_-]+|[^\p{L}\p{Nd}_-]+$", "")))
    return F.array_distinct(F.filter(bare, lambda w: w != ""))


def is_greeting(text: Column) -> Column:
    """Whether a text of fewer than 20 bytes is a greeting, alone or before a blank, ! or ?."""
    t = F.lower(trim_all(text))
    return (F.octet_length(text) < 20) & _any([(t == g) | t.startswith(g + " ") | t.startswith(g + "!") | t.startswith(g + "?") for g in GREETINGS])


def interface_language(code: Column) -> Column:
    """ru or en of a language code by its first two letters; en for others, ru for none."""
    two = F.lower(F.left(F.coalesce(code, F.lit("")), F.lit(2)))
    return F.when(two == "", "ru").when(two == "ru", "ru").otherwise("en")


def classify(text: Column) -> Column:
    """A struct of type, title, description, labels, priority and command."""
    t = trim_all(text)
    kind = F.when(is_question(t), "question").when(command(t).isNotNull(), "command").when(is_goal(t), "goal").otherwise("note")
    return F.struct(
        kind.alias("type"), title(t).alias("title"), F.when(is_question(t), t).otherwise(description(t)).alias("description"), hashtags(t).alias("labels"),
        F.when(kind == "goal", priority(t)).otherwise(F.lit(5)).alias("priority"), F.when(kind == "command", command(t)).alias("command"),
    )
