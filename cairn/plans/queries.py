"""Named queries of the core: (spark, folder) -> DataFrame over the whole tables of the folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import durations, messages, render, text
from cairn.operators import context, dig, goals, graph, instants, models, references, resources, search, sessions, timeline
from cairn.sources import adapters, store
from cairn.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = datetime(2026, 6, 1, 12, 0, 0)
WORD, KEYWORDS = "backup", ["graph", "НОЧ", "queue"]


def in_micros(df: DataFrame) -> DataFrame:
    """Timestamps as micros since 1970, which every engine writes alike."""
    return df.withColumns({c: F.unix_micros(c) for c, kind in df.dtypes if kind == "timestamp"}) if any(kind == "timestamp" for _, kind in df.dtypes) else df


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return in_micros(f(spark, folder))

    QUERIES[f.__name__] = run
    return f


# Problems 3 and 4.


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _broken(spark, folder).select("src", "row_id", "kind")


@query
def p3_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return references.broken_by_period(_broken(spark, folder))


def _broken(spark: SparkSession, folder: str) -> DataFrame:
    return references.broken_goal_references(*(table(spark, folder, n) for n in ("memories", "agent_commands", "goals")))


@query
def p3_composite(spark: SparkSession, folder: str) -> DataFrame:
    """Memories whose goal and status do not occur together in a goal's versions, where either may be null (partial match)."""
    m, g = table(spark, folder, "memories"), table(spark, folder, "goals")
    refs = m.select("seq", references.normal_goal_ref(F.col("value.goal_id")).alias("ref"), F.col("value.status").alias("status"), "received_at")
    targets = g.select(references.normal_goal_ref(F.col("id")).alias("key"), "status", "deleted", F.col("received_at").alias("target_at"))
    targets = targets.withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    return references.broken_references(refs, targets, ["ref", "status"], ["key", "status"], "seq", "received_at", "target_at", "deleted", match="partial").select(F.col("seq").alias("row_id"), "kind")


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    values = instants.time_values(*(table(spark, folder, n) for n in ("memories", "goals", "timeline_events")))
    found = instants.normalise_times(values, table(spark, folder, "source_clocks"))
    return found.where(F.col("utc_micros").isNotNull()).select("src", "row_id", "utc_micros")


# Keyed values.


@query
def kv_current(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.memories(spark, folder)


@query
def kv_put(spark: SparkSession, folder: str) -> DataFrame:
    """The state after every technical note got a new version."""
    log = adapters.memory_log(spark, folder)
    rows = store.current(log).where(F.col("key").startswith("memory/technical/")).select("key", F.concat("value", F.lit("*")).alias("value"), F.lit(NOW).alias("created_at"), F.lit(0).alias("n"))
    return store.current(store.put(log, rows, 10**12)).select("key", "value", "created_at", "modified_at")


@query
def kv_delete(spark: SparkSession, folder: str) -> DataFrame:
    """The state after all technical notes, and a key that never was, are deleted."""
    log = adapters.memory_log(spark, folder)
    keys = log.where(F.col("key").startswith("memory/technical/")).select("key").distinct()
    keys = keys.unionByName(spark.createDataFrame([("memory/none",)], "key string")).withColumn("n", F.lit(0))
    return store.current(store.delete(log, keys, 10**12, F.lit(NOW))).select("key", "created_at")


@query
def kv_auto_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.messages(spark, folder).select("command_id", F.when(F.col("command_id") % 2 == 0, F.concat(F.lit("k/"), F.col("command_id").cast("string"))).otherwise("").alias("key"), "text", F.lit(NOW).alias("created_at"))
    return store.with_auto_keys(rows, F.col("command_id") % 3 == 0).select("command_id", "key")


@query
def kv_get(spark: SparkSession, folder: str) -> DataFrame:
    first = adapters.memory_log(spark, folder).agg(F.min("key")).first()[0]
    return store.get(adapters.memories(spark, folder), first or "")


@query
def kv_get_batch(spark: SparkSession, folder: str) -> DataFrame:
    """A batch of every goal mirror's and every command's key, in their order, with those that do not exist."""
    keys = table(spark, folder, "agent_commands").select(F.col("command_id").alias("pos"), "key")
    return store.get_batch(adapters.memories(spark, folder), keys)


@query
def kv_list(spark: SparkSession, folder: str) -> DataFrame:
    return store.listing(adapters.memories(spark, folder), "memory/project/")


@query
def kv_list_top(spark: SparkSession, folder: str) -> DataFrame:
    return store.listing(adapters.memories(spark, folder), "memory/")


@query
def kv_list_dates(spark: SparkSession, folder: str) -> DataFrame:
    bad, good = store.parsed_bound("last week"), store.parsed_bound("2026-03-01T00:00:00Z")
    return store.listing(adapters.memories(spark, folder), "memory/user/", bad, good)


@query
def kv_list_recursive(spark: SparkSession, folder: str) -> DataFrame:
    return store.leaves(adapters.memories(spark, folder), "memory/reminder/").select("key")


@query
def kv_info(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.memories(spark, folder).select("key", "created_at", "modified_at")


# Keyword search.


@query
def find(spark: SparkSession, folder: str) -> DataFrame:
    return search.find(adapters.memories(spark, folder), WORD)


@query
def find_cyrillic(spark: SparkSession, folder: str) -> DataFrame:
    return search.find(adapters.memories(spark, folder), "архив", 500)


@query
def find_wildcard(spark: SparkSession, folder: str) -> DataFrame:
    return search.matches(adapters.memories(spark, folder), "Vector_s%quiet").select("key")


@query
def find_counts(spark: SparkSession, folder: str) -> DataFrame:
    kv = adapters.memories(spark, folder)
    return search.matches(kv, WORD).agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


@query
def keyword_hits(spark: SparkSession, folder: str) -> DataFrame:
    kv = adapters.memories(spark, folder)
    hits = dig.keyword_hits(F.concat("key", F.lit(" "), "value"), KEYWORDS)
    return kv.select("key", F.array_join(hits, ",").alias("hits")).where(F.col("hits") != "")


# Scenes.


def _dig(spark: SparkSession, folder: str) -> DataFrame:
    return dig.scenes(adapters.memories(spark, folder), WORD, KEYWORDS, "1d", 10)


@query
def dig_scenes(spark: SparkSession, folder: str) -> DataFrame:
    return _dig(spark, folder).select("match_key", "relevance", F.array_join("keywords", ",").alias("keywords"), F.size("before").alias("n_before"), F.size("after").alias("n_after"))


@query
def dig_entries(spark: SparkSession, folder: str) -> DataFrame:
    return dig.entries(adapters.memories(spark, folder), WORD, KEYWORDS, "1d", 10).select("match_key", "side", "key", "delta")


@query
def time_window(spark: SparkSession, folder: str) -> DataFrame:
    """How many events lie within an hour of each event, itself included: the band join over a whole table, against counts by second."""
    e = adapters.timeline(spark, folder)
    points = e.select("id", F.date_trunc("second", "created_at").alias("at"))
    seconds = e.groupBy(F.date_trunc("second", "created_at").alias("created_at")).agg(F.count("*").alias("k"))
    return dig.in_window(points, seconds, 3600.0).groupBy("id").agg(F.sum("k").alias("n"))


@query
def flex_duration(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "agent_commands").select("command_id", F.concat(F.col("priority").cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("d", "h", "m", "s", "h30m", "x")]), (F.col("command_id") % 6 + 1).cast("int"))).alias("t"))
    return texts.select("command_id", durations.whole_seconds(F.col("t")).alias("seconds"))


@query
def fmt_delta(spark: SparkSession, folder: str) -> DataFrame:
    e = adapters.timeline(spark, folder)
    return e.select("id", durations.delta_text(F.unix_timestamp("created_at") - F.lit(1767225600)).alias("delta"))


# Vectors.


def _first_vector(spark: SparkSession, folder: str) -> list[float]:
    return [float(x) for x in adapters.vectors(spark, folder).orderBy("vec_id").first()["embedding"]]


@query
def vector_cosine(spark: SparkSession, folder: str) -> DataFrame:
    q = _first_vector(spark, folder)
    return adapters.vectors(spark, folder).select("key", F.round(search.cosine(F.col("embedding"), q), 6).alias("score"))


@query
def vector_search(spark: SparkSession, folder: str) -> DataFrame:
    found = search.search(adapters.vectors(spark, folder), _first_vector(spark, folder), 10)
    return found.select("key", F.round("score", 6).alias("score"))


@query
def vector_search_values(spark: SparkSession, folder: str) -> DataFrame:
    found = search.search(adapters.vectors(spark, folder), _first_vector(spark, folder), 20)
    return search.with_values(found, adapters.vector_values(spark, folder)).select("key", F.round("score", 6).alias("score"), "content")


@query
def vector_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 50."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.nearest(rows.where(F.col("id") % 50 == 0), rows, 10).select("query_id", "id", F.round("score", 6).alias("score"))


# Goals.


@query
def goal_current(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.goals(spark, folder).withColumn("labels", F.array_join("labels", ","))


@query
def goal_get(spark: SparkSession, folder: str) -> DataFrame:
    g = adapters.goals(spark, folder)
    last = g.agg(F.max("id")).first()[0]
    return goals.get(g, last or "").select("id", "title", "status")


@query
def goal_list(spark: SparkSession, folder: str) -> DataFrame:
    return goals.listed(adapters.goals(spark, folder), "active").select("id", "title", "priority", "progress")


@query
def goal_list_label(spark: SparkSession, folder: str) -> DataFrame:
    return goals.listed(adapters.goals(spark, folder), "", ["PROJECT"]).select("id", F.array_join("labels", ",").alias("labels"))


@query
def goal_create(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "agent_commands").where(F.col("call") == "create_goal")
    asked = c.select(F.concat(F.lit("goal/"), F.date_format("received_at", "yyyy-MM-dd"), F.lit("/"), F.col("command_id").cast("string")).alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.concat(F.coalesce("content", F.lit("")), F.when(F.col("command_id") % 2 == 0, "\n- [x] one\n* [ ] two\n+ [X] three").otherwise("")).alias("description"), text.given_labels(F.col("labels")).alias("labels"), goals.clamped(F.col("priority")).alias("priority"), "deadline", F.col("received_at").alias("created_at"))
    return goals.created(asked).select("id", "title", "status", F.array_join("labels", ",").alias("labels"), "priority", "progress")


@query
def goal_update(spark: SparkSession, folder: str) -> DataFrame:
    """Completed goals get a new status, description and labels."""
    g = adapters.goals(spark, folder)
    fixed = F.lit("- [x] one\n- [ ] two\n* [X] three")
    p = g.where(F.col("status") == "completed").select("id", F.lit("").alias("title"), fixed.alias("description"), F.lit("archived").alias("status"), F.array(F.lit(" x "), F.lit("x"), F.lit("")).alias("labels"), F.lit(-1).alias("priority"), F.lit(-1).alias("progress"), F.lit("").alias("deadline"), F.lit(NOW).alias("at"))
    return goals.updated(g, p).select("id", "title", "status", F.array_join("labels", ",").alias("labels"), "priority", "progress", "updated_at")


@query
def goal_delete(spark: SparkSession, folder: str) -> DataFrame:
    g = adapters.goals(spark, folder)
    return goals.without(g, g.where(F.col("status") == "archived")).select("id", "status")


@query
def goal_mirror(spark: SparkSession, folder: str) -> DataFrame:
    return goals.mirror(adapters.goals(spark, folder)).withColumn("tags", F.array_join("tags", ","))


@query
def goal_show(spark: SparkSession, folder: str) -> DataFrame:
    return goals.shown(adapters.goals(spark, folder), "goal/2026-0").select("id", "title", text.status_icon(F.col("status")).alias("icon"), text.progress_bar(F.col("progress")).alias("bar"))


@query
def goal_progress(spark: SparkSession, folder: str) -> DataFrame:
    return goals.with_progress(adapters.goals(spark, folder))


@query
def goal_subtasks(spark: SparkSession, folder: str) -> DataFrame:
    return goals.subtasks(adapters.goals(spark, folder))


# Timeline.


@query
def timeline_range(spark: SparkSession, folder: str) -> DataFrame:
    rows = timeline.between(adapters.timeline(spark, folder), "2026-01-01", "2026-02-01", 100)
    return timeline.as_values(rows)


@query
def timeline_lines(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.lines(timeline.as_values(adapters.timeline(spark, folder)))


@query
def timeline_digest(spark: SparkSession, folder: str) -> DataFrame:
    events = timeline.as_values(adapters.timeline(spark, folder))
    return timeline.digest(events, goals.listed(adapters.goals(spark, folder), "active"))


@query
def tool_log(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "agent_commands")
    none = F.lit(None).cast("string")
    e = timeline.call_event(F.col("call"), F.col("key"), none, F.col("query"), F.col("goal_id"), none, F.col("text"))
    return c.select("command_id", e.alias("e")).select("command_id", "e.event_type", "e.key", "e.summary")


# Sessions.


@query
def session_save(spark: SparkSession, folder: str) -> DataFrame:
    rows = sessions.saved(adapters.sessions(spark, folder))
    return rows.groupBy("key").agg(F.count("*").alias("versions"))


@query
def session_latest(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.latest(adapters.sessions(spark, folder))


@query
def session_list(spark: SparkSession, folder: str) -> DataFrame:
    return store.listing(sessions.saved(adapters.sessions(spark, folder)), "session/project/")


@query
def session_compact(spark: SparkSession, folder: str) -> DataFrame:
    rows = sessions.saved(adapters.sessions(spark, folder)).select("key", "created_at").groupBy("key").agg(F.max("created_at").alias("created_at"))
    return sessions.compacted(rows, NOW, timedelta(days=30)).select("key")


@query
def session_compact_count(spark: SparkSession, folder: str) -> DataFrame:
    rows = sessions.saved(adapters.sessions(spark, folder)).groupBy("key").agg(F.max("created_at").alias("created_at"))
    return sessions.compact_count(rows, NOW, timedelta(days=30))


# Graph.


@query
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.touching(graph.read(graph.stored(adapters.edges(spark, folder))), "NATION_1").select("src", "dst", "relation")


@query
def graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return graph.neighbours(graph.read(graph.stored(adapters.edges(spark, folder))), "NATION_1")


@query
def graph_chains(spark: SparkSession, folder: str) -> DataFrame:
    return graph.chains(graph.read(graph.stored(adapters.edges(spark, folder))))


@query
def graph_reach(spark: SparkSession, folder: str) -> DataFrame:
    first = adapters.edges(spark, folder).agg(F.min("dst")).first()[0]
    return graph.reach(graph.read(graph.stored(adapters.edges(spark, folder))), first or "", 2)


# Context.


def _context(spark: SparkSession, folder: str, limit: int = 8) -> DataFrame:
    return context.memories(adapters.vectors(spark, folder), adapters.vector_values(spark, folder), _first_vector(spark, folder), limit)


def _context_lines(spark: SparkSession, folder: str, limit: int = 8) -> DataFrame:
    return context.lines(_context(spark, folder, limit), adapters.goals(spark, folder), context.reminders(adapters.memories(spark, folder), NOW))


@query
def context_memories(spark: SparkSession, folder: str) -> DataFrame:
    return _context(spark, folder).select("rank", "key", F.round("score", 6).alias("score"), "summary")


@query
def context_reminders(spark: SparkSession, folder: str) -> DataFrame:
    return context.reminders(adapters.memories(spark, folder), NOW)


@query
def context_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _context_lines(spark, folder)


@query
def context_counts(spark: SparkSession, folder: str) -> DataFrame:
    return context.counts(adapters.vectors(spark, folder), adapters.vector_values(spark, folder), adapters.goals(spark, folder), _first_vector(spark, folder), 8)


# Views and lines for people to read.


@query
def resource_goals(spark: SparkSession, folder: str) -> DataFrame:
    return resources.goal_view(adapters.goals(spark, folder))


@query
def resource_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return resources.timeline_view(adapters.timeline(spark, folder))


@query
def resource_insights(spark: SparkSession, folder: str) -> DataFrame:
    return resources.insights(adapters.goals(spark, folder), adapters.timeline(spark, folder), _ideas)


@query
def suggest_prompt(spark: SparkSession, folder: str) -> DataFrame:
    return models.suggestion_prompt(adapters.goals(spark, folder), adapters.timeline(spark, folder), "now", 3, "ru").select("prompt")


@query
def resource_awareness(spark: SparkSession, folder: str) -> DataFrame:
    return resources.awareness(adapters.goals(spark, folder), adapters.timeline(spark, folder), context.text(_context_lines(spark, folder, 10), NOW))


@query
def context_text(spark: SparkSession, folder: str) -> DataFrame:
    """The whole text that is put before a question, as one row."""
    return context.text(_context_lines(spark, folder), NOW)


@query
def render_cards(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.goals(spark, folder).select("id", render.goal_card(F.col("title"), F.col("description"), F.col("labels"), F.col("deadline"), F.col("progress")).alias("card"))


@query
def render_hits(spark: SparkSession, folder: str) -> DataFrame:
    return _context(spark, folder).select(render.hit_line(F.col("rank"), F.col("key"), F.col("score"), F.col("content")).alias("line"))


# Texts of messages.


@query
def classify(spark: SparkSession, folder: str) -> DataFrame:
    m = adapters.messages(spark, folder).where(F.col("text").isNotNull())
    return m.select("command_id", messages.classify(F.col("text")).alias("c")).select("command_id", "c.type", "c.title", "c.description", F.array_join("c.labels", ",").alias("labels"), "c.priority", "c.command")


@query
def greetings(spark: SparkSession, folder: str) -> DataFrame:
    """Whole messages, greetings, and messages after a greeting."""
    m = adapters.messages(spark, folder).where(F.col("text").isNotNull())
    word = F.element_at(F.array(*[F.lit(g) for g in messages.GREETINGS]), (F.col("command_id") % len(messages.GREETINGS) + 1).cast("int"))
    said = F.when(F.col("command_id") % 3 == 0, F.col("text")).when(F.col("command_id") % 3 == 1, word).otherwise(F.concat(word, F.lit(" "), "text"))
    return m.select("command_id", messages.is_greeting(said).alias("greeting"), messages.interface_language(F.col("lang")).alias("language"))


@query
def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of commands, which are JSON arrays or texts with commas, cleaned."""
    return adapters.messages(spark, folder).select("command_id", F.array_join(text.given_labels(F.col("labels")), ",").alias("labels"), text.labels_text(text.given_labels(F.col("labels"))).alias("shown"))


@query
def text_forms(spark: SparkSession, folder: str) -> DataFrame:
    m = adapters.messages(spark, folder)
    t = F.col("text")
    return m.select("command_id", text.cut(t, 20).alias("cut"), text.cut(t, 30, "...").alias("dots"), text.cut(t, 25, "…", 24).alias("within"), text.cut(t, 24, "...", 21).alias("short"), text.escape_html(F.concat(t, F.lit(" <&>"))).alias("html"), text.prompt_cap(F.repeat(t, 60)).alias("prompt"))


@query
def json_repair(spark: SparkSession, folder: str) -> DataFrame:
    m = adapters.messages(spark, folder)
    broken = F.concat(F.lit('[{"title="'), F.regexp_replace("text", r'[",}\]]', ""), F.lit('","type=note}]'))
    return m.select("command_id", text.repaired_json(broken).alias("json"))


@query
def suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Suggestions read out of answers with words around them."""
    m = adapters.messages(spark, folder)
    plain = F.regexp_replace("text", r'[",}\]\\\[]', "")
    answer = F.concat(F.lit('Here: [{"title":"'), plain, F.lit('","type=note,"priority":3},{"title":"b","type":"goal"}] and so on'))
    return m.select("command_id", F.explode(models.suggestions(answer, 1)).alias("s")).select("command_id", "s.type", "s.title", "s.priority")


@query
def model_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Answers read back out of the bodies of three kinds of servers."""
    m = adapters.messages(spark, folder).where(F.col("answer").isNotNull())
    a = F.col("answer")
    half = F.floor(F.length(a) / 2).cast("int")
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(a.alias("content")).alias("message"))).alias("choices")))
    one = F.to_json(F.struct(F.struct(a.alias("content")).alias("message")))
    part = lambda x: F.to_json(F.struct(F.struct(x.alias("content")).alias("message")))
    lines = F.concat(part(F.left(a, half)), F.lit("\n"), part(F.substring(a, half + 1, F.length(a))))
    body = F.when(F.col("command_id") % 3 == 0, chat).when(F.col("command_id") % 3 == 1, one).otherwise(lines)
    return m.select("command_id", text.reply_text(body).alias("reply"))


@query
def agent_commands(spark: SparkSession, folder: str) -> DataFrame:
    """Commands read out of plain, fenced and surrounded JSON, and plain text."""
    m = table(spark, folder, "agent_commands")
    j = F.to_json(F.struct("call", "text"))
    raw = F.when(F.col("command_id") % 4 == 0, j).when(F.col("command_id") % 4 == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(F.col("command_id") % 4 == 2, F.concat(F.lit("Sure: "), j, F.lit(" ok"))).otherwise(F.col("text"))
    return m.select("command_id", models.command(raw).alias("c")).select("command_id", "c.call", "c.text", "c.answer")


@query
def conversations(spark: SparkSession, folder: str) -> DataFrame:
    m = adapters.messages(spark, folder)
    return models.conversation(m.select(F.col("command_id").alias("id"), F.col("text").alias("said"), F.col("answer").alias("answered")))


@query
def extracted_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that a stand-in for a model finds: each text's own beginning, as its only fact."""
    m = adapters.messages(spark, folder).select(F.col("command_id").alias("id"), "text")
    return models.facts_as_values(models.extract_facts(m, _echo), F.lit(NOW)).select("key", "content", "summary", "source")


@query
def question_answers(spark: SparkSession, folder: str) -> DataFrame:
    """What a stand-in for a model says to each message as a question without notes."""
    m = adapters.messages(spark, folder).select(F.col("command_id").alias("id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("context"))
    return models.answered_questions(m, _asked).select("id", "answer")


def _asked(prompts: list[str]) -> list[str]:
    return ["asked: " + p.split("\n\nQuestion: ", 1)[1] for p in prompts]


def _ideas(prompts: list[str]) -> list[str]:
    import json

    seen = [f"{p.count('(progress: ')} goals, {len([x for x in p.split('Recent activity:', 1)[1].splitlines() if x.startswith('[20')])} events" for p in prompts]
    return [json.dumps([{"type": "insight", "title": t, "description": str(k), "priority": k} for k in range(7)]) for t in seen]


def _echo(prompts: list[str]) -> list[str]:
    import json

    return ["Facts: " + json.dumps([{"content": p.split("\n\n", 1)[1], "summary": "echo", "tags": ["t"]}]) + "." for p in prompts]
