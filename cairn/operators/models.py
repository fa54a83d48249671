"""Steps around a language model, which is any function from a list of prompts to a list of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import auto_key, between, prompt_cap, repaired_json, trim_all
from cairn.operators import goals as goal_ops
from cairn.operators import timeline as timeline_ops

FACTS = "array<struct<content: string, summary: string, tags: array<string>>>"
SUGGESTIONS = "array<struct<type: string, title: string, description: string, priority: int>>"
COMMAND = "call string, query string, title string, text string, content string, priority int, progress int, status string, goal_id string, key string, answer string"
Model = Callable[[list[str]], list[str]]


def answers(prompts: DataFrame, model: Model) -> DataFrame:
    """id, prompt, answer, error of `prompts` (id, prompt), asked for in batches inside the tasks. Null and blank prompts are not asked and get null.

    error: why there is no answer, of models that tell it (with a method asked(), see HttpModel); null else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            asked = [i for i, t in enumerate(texts) if t and t.strip()]
            tell = getattr(model, "asked", None) or (lambda prompts: [(answer, None) for answer in model(prompts)])
            got = dict(zip(asked, tell([texts[i] for i in asked]))) if asked else {}
            both = [got.get(i, (None, None)) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([b[k] for b in both], pa.string()) for k in range(2))], ["id", "prompt", "answer", "error"])

    return prompts.select(F.col("id").cast("string").alias("id"), "prompt").mapInArrow(run, "id string, prompt string, answer string, error string")


def array_of(answer: Column, schema: str) -> Column:
    """The JSON array in an answer: the whole answer, else what stands between its first [ and last ]; null if neither is one."""
    bare = trim_all(answer)
    return F.coalesce(F.from_json(F.when(bare.startswith("["), bare), schema), F.from_json(between(answer, "[", "]"), schema))


def fact_prompt(text: Column) -> Column:
    return F.concat(F.lit("List the facts in this text as a JSON array of objects with content, summary and tags.\n\n"), prompt_cap(text))


def extract_facts(texts: DataFrame, model: Model) -> DataFrame:
    """id, position, content, summary, tags of the facts that a model finds in texts (id, text). Blank texts have none, unreadable answers neither."""
    asked = texts.select("id", F.when(trim_all(F.coalesce("text", F.lit(""))) != "", fact_prompt(F.col("text"))).alias("prompt"))
    found = answers(asked, model).select("id", F.posexplode(array_of(F.col("answer"), FACTS)).alias("position", "f"))
    return found.select("id", "position", "f.content", "f.summary", F.coalesce("f.tags", F.array().cast("array<string>")).alias("tags"))


def facts_as_values(facts: DataFrame, at: Column) -> DataFrame:
    """key, content, summary, tags, source of facts, under keys made of their contents."""
    return facts.select(auto_key(F.col("content"), at).alias("key"), "content", "summary", "tags", F.lit("auto-extract").alias("source"))


def suggestions(answer: Column, limit: int = 5) -> Column:
    """At most `limit` suggestions of an answer whose usual mistakes are repaired first."""
    return F.slice(array_of(repaired_json(answer), SUGGESTIONS), 1, limit)


def suggestion_prompt(goals: DataFrame, events: DataFrame, context: str, limit: int = 5, lang: str = "en") -> DataFrame:
    """One row (id, prompt): asks for suggestions about a context, with the active goals (1000 at most) and the five newest events."""
    none = F.lit("")
    g = goal_ops.listed(goals, "active").withColumn("k", F.row_number().over(Window.orderBy(F.desc("priority"), F.desc("created_at"), "id")))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    sign = F.when(F.col("progress") >= 100, "✓").otherwise("⏳")
    goal = F.concat(sign, F.lit(" "), F.coalesce("title", none), F.lit(": "), F.coalesce("description", none), F.lit(" (progress: "), number("progress"), F.lit("%, priority: "), number("priority"), F.lit(")"))
    e = timeline_ops.as_values(timeline_ops.between(events, limit=5)).withColumn("k", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))))
    newest = timeline_ops.lines(e).join(e.select("id", "k"), "id").select("k", "line")
    joined = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", rows))), lambda s: s["x"]), "\n")
    both = g.select("k", goal.alias("x")).agg(joined("x").alias("goals")).crossJoin(newest.select("k", F.col("line").alias("x")).agg(joined("x").alias("events")))
    ask = f"Context: {context}\nAnswer in the language {lang}. Suggest {limit} things at most, as a JSON array of objects with type (reminder, followup, goal_next_step or insight), title, description and priority (0 to 10)."
    return both.select(F.lit("suggest").alias("id"), F.concat(F.lit(ask + "\n\nActive goals:\n"), "goals", F.lit("\n\nRecent activity:\n"), "events").alias("prompt"))


def suggest(goals: DataFrame, events: DataFrame, model: Model, context: str, limit: int = 5, lang: str = "en") -> DataFrame:
    """position, type, title, description, priority that a model suggests: five for a limit of 0 or less. An answer that cannot be read gives none."""
    limit = limit if limit > 0 else 5
    asked = answers(suggestion_prompt(goals, events, context, limit, lang), model)
    return asked.select(F.posexplode(suggestions(F.col("answer"), limit)).alias("position", "s")).select("position", "s.type", "s.title", "s.description", "s.priority")


def answered_questions(questions: DataFrame, model: Model) -> DataFrame:
    """id, question, answer of questions (id, question, context): a model answers each from its context, which may be empty or null. Blank questions are not asked."""
    ask = F.concat(F.lit("Answer the question from the notes; say so if they do not hold the answer.\n\nNotes:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("question"))
    asked = answers(questions.select("id", F.when(trim_all(F.coalesce("question", F.lit(""))) != "", ask).alias("prompt")), model)
    return questions.select(F.col("id").cast("string").alias("id"), "question").join(asked.select("id", "answer"), "id", "left")


def conversation(turns: DataFrame) -> DataFrame:
    """id, text of turns (id, said, answered); turns that are blank on both sides are left out."""
    said, answered = F.coalesce("said", F.lit("")), F.coalesce("answered", F.lit(""))
    rows = turns.where((trim_all(said) != "") | (trim_all(answered) != ""))
    return rows.select("id", F.concat(F.lit("User: "), said, F.lit("\nAssistant: "), answered, F.lit("\n")).alias("text"))


def _usable(text: Column) -> Column:
    c = F.from_json(text, COMMAND)
    return F.when((F.coalesce(c["call"], F.lit("")) != "") | (F.coalesce(c["answer"], F.lit("")) != ""), c)


def command(raw: Column) -> Column:
    """The command in a model's answer: JSON as it is, in a fenced block, or anywhere in braces; else the answer itself as plain text. Null for empty JSON."""
    t = trim_all(raw)
    lines = F.replace(t, F.lit("\\n"), F.lit("\n"))
    fence = F.nullif(trim_all(F.regexp_extract(lines, r"(?s)```(?:json)?(.*?)```", 1)), F.lit(""))
    found = F.coalesce(_usable(t), _usable(fence), _usable(between(fence, "{", "}")), _usable(lines), _usable(between(lines, "{", "}")))
    plain = F.from_json(F.to_json(F.struct(t.alias("answer"))), COMMAND)
    return F.when((t != "") & (t != "{}") & (t != '{"call":"","answer":""}'), F.coalesce(found, plain))


def endpoint(base: str, path: str) -> str:
    """A server's address with a path under it; a version that both name is named once."""
    base = base if base.endswith("/") else base + "/"
    path = path.lstrip("/")
    if base.endswith("/v1/") and path.startswith("v1/"):
        path = path[3:]
    return urljoin(base, path)
