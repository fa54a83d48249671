"""The same queries in SQL, for checking results."""

from __future__ import annotations

# Nothing of the code under test is imported: what must be the same is written out here again.

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: LIKE patterns of the keywords that are looked for.
PATTERNS = {"backup": ["%backup%"], "архив": ["%архив%", "%Архив%"], "Vector_s%quiet": ["%vector_s%quiet%"]}
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

# Shapes of the tables, twins of sources/adapters.py.

_REF = r"nullif(regexp_replace(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^memory/goals/[^/]*/', ''), '/$|^\s+|\s+$', '', 'g'), '')"
_BROKEN = f"""
    WITH refs AS (
        SELECT 'memories' AS src, seq AS row_id, {_REF.format('value.goal_id')} AS ref, received_at FROM memories
        UNION ALL SELECT 'agent_commands', command_id, {_REF.format('goal_id')}, received_at FROM agent_commands
    ), states AS (
        SELECT {_REF.format('id')} AS ref, min(received_at) AS first_at, min(CASE WHEN deleted THEN received_at END) AS gone_at FROM goals GROUP BY 1
    ), broken AS (
        SELECT src, row_id, received_at, CASE WHEN first_at IS NULL THEN 'missing' WHEN gone_at <= received_at THEN 'deleted' WHEN first_at > received_at THEN 'late' END AS kind
        FROM refs LEFT JOIN states USING (ref) WHERE ref IS NOT NULL
    )"""
_VALUE = """'{"content":"' || coalesce(value.content, '') || '","summary":"' || coalesce(value.summary, '') || '"}'"""
_KV = f"""kv AS (
        SELECT key, arg_max({_VALUE}, seq) AS value, arg_min(date_trunc('second', received_at), seq) AS created_at, arg_max(date_trunc('second', received_at), seq) AS modified_at
        FROM memories WHERE key IS NOT NULL GROUP BY key
    )"""
_CLEAN = r"list_filter(list_transform({0}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x IS NOT NULL AND x <> '')"
#: list_distinct keeps no order, so repeats are left out by their first place.
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _labels(column: str) -> str:
    t = rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"
    parts = f"CASE WHEN {t} LIKE '[%' THEN from_json({t}, '[\"VARCHAR\"]') ELSE string_split({t}, ',') END"
    return _FIRST.format(_CLEAN.format(parts))


_GOALS = f"""g AS (
        SELECT id, arg_max(title, seq) AS title, arg_max(description, seq) AS description, arg_max(status, seq) AS status, coalesce(arg_max(labels, seq), '') AS raw,
               arg_max(priority, seq) AS priority, arg_max(progress, seq) AS progress, arg_max(deadline, seq) AS deadline, min(received_at) AS created_at, max(received_at) AS updated_at,
               arg_max(coalesce(deleted, false), seq) AS gone
        FROM (SELECT seq, id, coalesce(title, '\x01') AS title, coalesce(description, '\x01') AS description, coalesce(status, '\x01') AS status, coalesce(labels, '') AS labels,
                     coalesce(priority, -999) AS priority, coalesce(progress, -999) AS progress, coalesce(deadline, '\x01') AS deadline, received_at, deleted FROM goals) GROUP BY id
    ), goal AS (
        SELECT id, nullif(title, '\x01') AS title, nullif(description, '\x01') AS description, nullif(status, '\x01') AS status, {_labels('raw')} AS labels, nullif(priority, -999) AS priority,
               nullif(progress, -999) AS progress, nullif(deadline, '\x01') AS deadline, created_at, updated_at FROM g WHERE NOT gone
    )"""
_SESSIONS = """s AS (SELECT replace(project, '/', '-') AS project, text AS data, date_trunc('second', created_at) AS created_at, doc_id AS n FROM documents WHERE kind = 'session' AND project IS NOT NULL),
    saved AS (
        SELECT 'session/project/' || project || '/latest' AS key, created_at FROM s
        UNION ALL SELECT 'session/project/' || project || '/' || strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'), created_at FROM s
    )"""
_EDGES = """edge AS (
        SELECT n_name AS src, r_name AS dst, 'in_region' AS relation FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT c_name, n_name, 'from_nation' FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT s_name, n_name, 'from_nation' FROM supplier JOIN nation ON s_nationkey = n_nationkey
    )"""
_SCORES = """q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1),
    scored AS (SELECT 'memory/vec/' || vec_id AS key, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q)"""
#: The best hits of a question with their values, numbered without those that have none, and the active goals.
_CONTEXT = f"""{_SCORES}, {_GOALS}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS rank FROM scored QUALIFY rank <= MOST_HITS),
    hit AS (
        SELECT row_number() OVER (ORDER BY rank) AS k, rank, key, score, text AS content, coalesce(project, '') AS summary, created_at, list_filter([kind, source], lambda x: x IS NOT NULL) AS tags,
            CASE WHEN doc_id % 3 = 0 THEN 'goal/' || doc_id END AS goal_id FROM top JOIN documents ON 'memory/vec/' || doc_id = key
    ), act AS (
        SELECT *, row_number() OVER (ORDER BY priority DESC, created_at DESC, id) AS k FROM (SELECT * FROM goal WHERE status = 'active' ORDER BY priority DESC, created_at DESC, id LIMIT 1000)
    ), late AS (
        SELECT row_number() OVER (ORDER BY received_at DESC, id DESC) AS k, id,
            '[' || strftime(received_at AT TIME ZONE 'UTC', '%Y-%m-%d') || '] ' || coalesce(key, '') || ': ' || CASE WHEN length(summary) > 80 THEN left(summary, 80) || '…' ELSE coalesce(summary, '') END AS line
        FROM timeline_events QUALIFY k <= 5
    )"""
#: The same, with the lines of all sections.
_LINES = f"""{_CONTEXT}, {_KV}, lines AS (
        SELECT 1 AS section, k AS position, k || '. [' || strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') || '] ' || coalesce(content, '') || ' (score: ' || printf('%.2f', score) || ')'
            || CASE WHEN summary <> '' THEN chr(10) || '   Summary: ' || summary ELSE '' END || CASE WHEN len(tags) > 0 THEN chr(10) || '   Tags: ' || array_to_string(tags, ', ') ELSE '' END
            || CASE WHEN goal_id IS NOT NULL THEN chr(10) || '   Goal: ' || goal_id ELSE '' END AS line FROM hit
        UNION ALL SELECT 2, k, k || '. ' || coalesce(title, '') || ' [' || coalesce(progress, 0) || '%] priority=' || coalesce(priority, 0) || ' deadline=' || coalesce(deadline, '')
            || CASE WHEN coalesce(description, '') <> '' THEN chr(10) || '   ' || description ELSE '' END FROM act
        UNION ALL SELECT 3, 0, '- [' || key || '] ' || coalesce(value, '') FROM kv WHERE starts_with(key, 'memory/reminder/') AND key NOT LIKE '%/'
            AND (try_cast(split_part(key, '/', 3) AS DATE) IS NULL OR split_part(key, '/', 4) = '' OR try_cast(split_part(key, '/', 3) AS DATE) >= TIMESTAMP '2026-05-31 12:00:00')
            AND EXISTS (SELECT 1 FROM hit UNION ALL SELECT 1 FROM act)
    ), whole AS (
        SELECT CASE WHEN count(*) > 0 THEN '2026-06-01 12:00:00' || chr(10) || string_agg(head || chr(10) || body, chr(10) ORDER BY section) ELSE '' END AS text FROM (
            SELECT section, ['=== Relevant memories ===', chr(10) || '=== Active goals ===', chr(10) || '=== Upcoming reminders ==='][section] AS head, string_agg(line, chr(10) ORDER BY position, line) AS body FROM lines GROUP BY section)
    )"""
def _for(sql: str, hits: int) -> str:
    return sql.replace("MOST_HITS", str(hits))


_NOW = "TIMESTAMPTZ '2026-06-01 12:00:00+00'"


def _like(column: str, word: str) -> str:
    return "(" + " OR ".join(f"translate({column}, '{UPPER}', '{LOWER}') LIKE '{p}'" for p in PATTERNS[word]) + ")"


def _match(word: str) -> str:
    return f"({_like('key', word)} OR {_like('value', word)})"


def _starts(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{w}')" for w in words) + ")"


def _holds(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_HITS = "list_filter(['graph', 'НОЧ', 'queue'], lambda k: contains(lower({0}), lower(k)))"
_DELTA = "(CASE WHEN {0} < 0 THEN '-' ELSE '+' END) || CASE WHEN abs({0}) // 3600 > 0 THEN (abs({0}) // 3600) || 'h' ELSE '' END || ((abs({0}) // 60) % 60) || 'm'"
_DIG = f"""WITH {_KV}, m AS (SELECT key AS match_key, created_at AS match_at FROM kv WHERE {_match('backup')} ORDER BY key LIMIT 10),
    w AS (
        SELECT match_key, match_at, key, value, created_at, row_number() OVER (PARTITION BY match_key ORDER BY created_at, key) AS n
        FROM m JOIN kv ON created_at BETWEEN match_at - INTERVAL 1 DAY AND match_at + INTERVAL 1 DAY
    ), e AS (SELECT *, CAST(epoch(created_at) - epoch(match_at) AS BIGINT) AS delta, {_HITS.format("key || ' ' || value")} AS hits FROM w WHERE n <= 20 AND key <> match_key)"""
_HTML = "replace(replace(replace({0}, '&', '&#38;'), '<', '&#60;'), '>', '&#62;')"
_SUBTASK = r"(?m)^\s*[-*+]\s+\[([ xX])\]"
_MARKS = f"regexp_extract_all(coalesce(description, ''), '{_SUBTASK}', 1)"
_CLASS = rf"""WITH t AS (SELECT command_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM agent_commands WHERE text IS NOT NULL), l AS (SELECT *, lower(t) AS low, position(chr(10) IN t) AS nl FROM t),
    k AS (
        SELECT *, ({_starts('low', QUESTION)} OR t LIKE '%?') AS q,
            CASE {' '.join(f"WHEN {_starts('low', w)} OR {_holds('low', [' ' + x for x in w])} THEN '{n}'" for n, w in COMMANDS.items())} END AS c,
            ({_starts('low', GOAL)} OR {_holds('low', GOAL_MARKS)}) AS g,
            CASE WHEN {_holds('low', HIGH)} THEN 9 WHEN {_holds('low', LOW)} THEN 2 ELSE 5 END AS p,
            CASE WHEN nl > 0 THEN regexp_replace(left(t, nl - 1), '^\s+|\s+$', '', 'g') ELSE left(t, 80) END AS title,
            CASE WHEN nl > 0 THEN regexp_replace(substr(t, nl + 1), '^\s+|\s+$', '', 'g') ELSE t END AS rest,
            list_filter(list_transform(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w LIKE '#_%'), lambda w: lower(regexp_replace(substr(w, 2), '^[^\pL\p{{Nd}}_-]+|[^\pL\p{{Nd}}_-]+$', '', 'g'))), lambda w: w <> '') AS tags
        FROM l
    ), y AS (SELECT *, CASE WHEN q THEN 'question' WHEN c IS NOT NULL THEN 'command' WHEN g THEN 'goal' ELSE 'note' END AS type FROM k)
    SELECT command_id, type, CASE WHEN title = '' THEN rest ELSE title END AS title, CASE WHEN q THEN t ELSE rest END AS description,
        array_to_string({_FIRST.format('tags')}, ',') AS labels, CASE WHEN type = 'goal' THEN p ELSE 5 END AS priority, CASE WHEN type = 'command' THEN c END AS command FROM y"""

ORACLE: dict[str, str] = {
    "p3_found": f"{_BROKEN} SELECT src, row_id, kind FROM broken WHERE kind IS NOT NULL",
    "p3_composite": f"""WITH refs AS (SELECT seq AS row_id, {_REF.format('value.goal_id')} AS ref, value.status AS status, received_at FROM memories), versions AS (SELECT {_REF.format('id')} AS ref, status, deleted, received_at FROM goals),
        met AS (
            SELECT row_id, r.received_at, min(v.received_at) AS first_at, min(CASE WHEN v.deleted THEN v.received_at END) AS gone_at
            FROM refs r LEFT JOIN versions v ON (r.ref IS NULL OR r.ref = v.ref) AND (r.status IS NULL OR r.status = v.status) WHERE r.ref IS NOT NULL OR r.status IS NOT NULL GROUP BY row_id, r.received_at
        ), kinds AS (SELECT row_id, CASE WHEN first_at IS NULL THEN 'missing' WHEN gone_at <= received_at THEN 'deleted' WHEN first_at > received_at THEN 'late' END AS kind FROM met)
        SELECT * FROM kinds WHERE kind IS NOT NULL""",
    "p3_by_month": f"{_BROKEN} SELECT src, strftime(received_at AT TIME ZONE 'UTC', '%Y-%m') AS month, kind, count(*) AS n FROM broken WHERE kind IS NOT NULL GROUP BY 1, 2, 3",
    "kv_current": f"WITH {_KV} SELECT * FROM kv",
    "kv_put": f"""WITH {_KV} SELECT key, CASE WHEN starts_with(key, 'memory/technical/') THEN value || '*' ELSE value END AS value, created_at,
        CASE WHEN starts_with(key, 'memory/technical/') THEN {_NOW} ELSE modified_at END AS modified_at FROM kv""",
    "kv_delete": f"WITH {_KV} SELECT key, created_at FROM kv WHERE NOT starts_with(key, 'memory/technical/')",
    "kv_auto_key": """SELECT command_id, CASE WHEN command_id % 3 = 0 OR command_id % 2 = 1 THEN 'memory/auto/2026-06-01/' || left(md5(coalesce(text, '')), 8) ELSE 'k/' || command_id END AS key FROM agent_commands""",
    "kv_get": f"WITH {_KV} SELECT * FROM kv WHERE key = (SELECT min(key) FROM kv)",
    "kv_get_batch": f"WITH {_KV} SELECT command_id AS pos, a.key, value, value IS NOT NULL AS found FROM agent_commands a LEFT JOIN kv ON a.key = kv.key WHERE a.key IS NOT NULL AND a.key <> ''",
    "kv_list": f"WITH {_KV}, r AS (SELECT substr(key, 16) AS r FROM kv WHERE starts_with(key, 'memory/project/')) SELECT DISTINCT 'memory/project/' || CASE WHEN contains(r, '/') THEN split_part(r, '/', 1) || '/' ELSE r END AS entry FROM r",
    "kv_list_top": f"WITH {_KV}, r AS (SELECT substr(key, 8) AS r FROM kv WHERE starts_with(key, 'memory/')) SELECT DISTINCT 'memory/' || CASE WHEN contains(r, '/') THEN split_part(r, '/', 1) || '/' ELSE r END AS entry FROM r",
    "kv_list_dates": f"""WITH {_KV}, r AS (SELECT substr(key, 13) AS r FROM kv WHERE starts_with(key, 'memory/user/') AND created_at <= TIMESTAMPTZ '2026-03-01 00:00:00+00')
        SELECT DISTINCT 'memory/user/' || CASE WHEN contains(r, '/') THEN split_part(r, '/', 1) || '/' ELSE r END AS entry FROM r""",
    "kv_list_recursive": f"WITH {_KV} SELECT key FROM kv WHERE starts_with(key, 'memory/reminder/') AND key NOT LIKE '%/'",
    "kv_info": f"WITH {_KV} SELECT key, created_at, modified_at FROM kv",
    "find": f"WITH {_KV} SELECT key, value, created_at FROM kv WHERE {_match('backup')} ORDER BY key LIMIT 20",
    "find_cyrillic": f"WITH {_KV} SELECT key, value, created_at FROM kv WHERE {_match('архив')} ORDER BY key LIMIT 100",
    "find_wildcard": f"WITH {_KV} SELECT key FROM kv WHERE {_match('Vector_s%quiet')}",
    "find_counts": f"WITH {_KV} SELECT count(*) AS n, min(key) AS first_key FROM kv WHERE {_match('backup')}",
    "keyword_hits": f"WITH {_KV}, h AS (SELECT key, array_to_string({_HITS.format(chr(107) + 'ey || ' + chr(39) + ' ' + chr(39) + ' || value')}, ',') AS hits FROM kv) SELECT * FROM h WHERE hits <> ''",
    "dig_scenes": f"""{_DIG}, p AS (
            SELECT m.match_key, list_filter(['graph', 'НОЧ', 'queue'], lambda k: list_contains(flatten(list(coalesce(hits, []))), k)) AS k, count(*) FILTER (delta < 0) AS n_before, count(*) FILTER (delta >= 0) AS n_after
            FROM m LEFT JOIN e ON m.match_key = e.match_key GROUP BY m.match_key
        ) SELECT match_key, CAST(least(100, 50 + 25 * len(k)) AS INTEGER) AS relevance, array_to_string(k, ',') AS keywords, CAST(n_before AS INTEGER) AS n_before, CAST(n_after AS INTEGER) AS n_after FROM p""",
    "dig_entries": f"{_DIG} SELECT match_key, CASE WHEN delta < 0 THEN 'before' ELSE 'after' END AS side, key, {_DELTA.format('delta')} AS delta FROM e",
    "time_window": """WITH t AS (SELECT id, CAST(floor(epoch(received_at)) AS BIGINT) AS s FROM timeline_events), k AS (SELECT s AS x, count(*) AS k FROM t GROUP BY s)
        SELECT id, CAST(sum(k) AS BIGINT) AS n FROM t JOIN k ON x BETWEEN s - 3600 AND s + 3600 GROUP BY id""",
    "flex_duration": """SELECT command_id, CASE command_id % 6 WHEN 0 THEN priority * 86400 WHEN 1 THEN priority * 3600 WHEN 2 THEN priority * 60 WHEN 3 THEN priority WHEN 4 THEN priority * 3600 + 1800 END AS seconds FROM agent_commands""",
    "fmt_delta": f"WITH d AS (SELECT id, CAST(floor(epoch(received_at)) AS BIGINT) - 1767225600 AS d FROM timeline_events) SELECT id, {_DELTA.format('d')} AS delta FROM d",
    "vector_cosine": f"WITH {_SCORES} SELECT key, round(score, 6) AS score FROM scored",
    "vector_search": f"WITH {_SCORES} SELECT key, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, key LIMIT 10",
    "vector_search_values": f"""WITH {_SCORES}, top AS (SELECT * FROM scored ORDER BY score DESC, key LIMIT 20)
        SELECT key, round(score, 6) AS score, CASE WHEN length(t) > 200 THEN left(t, 200) || '…' ELSE t END AS content
        FROM (SELECT key, score, coalesce(nullif(text, ''), project, '') AS t FROM top LEFT JOIN documents ON 'memory/vec/' || doc_id = key)""",
    "vector_nearest": """WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM s) SELECT query_id, id, round(score, 6) AS score FROM k WHERE n <= 10""",
    "goal_current": f"WITH {_GOALS} SELECT id, title, description, status, array_to_string(labels, ',') AS labels, priority, progress, deadline, created_at, updated_at FROM goal",
    "goal_get": f"WITH {_GOALS} SELECT id, title, status FROM goal WHERE id = (SELECT max(id) FROM goal)",
    "goal_list": f"WITH {_GOALS} SELECT id, title, priority, progress FROM goal WHERE status = 'active' ORDER BY priority DESC, created_at DESC, id LIMIT 1000",
    "goal_list_label": f"WITH {_GOALS}, h AS (SELECT * FROM goal WHERE list_contains(list_transform(labels, lambda x: translate(x, '{UPPER}', '{LOWER}')), 'project') ORDER BY priority DESC, created_at DESC, id LIMIT 1000) SELECT id, array_to_string(labels, ',') AS labels FROM h",
    "goal_create": f"""WITH c AS (SELECT *, coalesce(content, '') || CASE WHEN command_id % 2 = 0 THEN chr(10) || '- [x] one' || chr(10) || '* [ ] two' || chr(10) || '+ [X] three' ELSE '' END AS description FROM agent_commands WHERE call = 'create_goal' AND coalesce(title, '') <> '')
        SELECT 'goal/' || strftime(received_at AT TIME ZONE 'UTC', '%Y-%m-%d') || '/' || command_id AS id, title, 'active' AS status, coalesce(array_to_string({_labels('labels')}, ','), '') AS labels,
        greatest(0, least(10, priority)) AS priority, CAST(CASE WHEN len({_MARKS}) > 0 THEN floor(len(list_filter({_MARKS}, lambda m: lower(m) = 'x')) * 100 / len({_MARKS})) ELSE 0 END AS INTEGER) AS progress FROM c""",
    "goal_update": f"""WITH {_GOALS} SELECT id, title, CASE WHEN status = 'completed' THEN 'archived' ELSE status END AS status, CASE WHEN status = 'completed' THEN 'x' ELSE array_to_string(labels, ',') END AS labels, priority,
        CASE WHEN status = 'completed' THEN 66 ELSE progress END AS progress, CASE WHEN status = 'completed' THEN {_NOW} ELSE updated_at END AS updated_at FROM goal""",
    "goal_delete": f"WITH {_GOALS} SELECT id, status FROM goal WHERE coalesce(status, '') <> 'archived'",
    "goal_mirror": f"WITH {_GOALS} SELECT 'memory/goals/' || coalesce(nullif(status, ''), 'active') || '/' || id AS key, description AS content, title AS summary, array_to_string(labels, ',') AS tags, 'goal-tracker' AS source FROM goal",
    "goal_show": f"""WITH {_GOALS}, f AS (SELECT * FROM goal WHERE starts_with(id, 'goal/2026-0') ORDER BY priority DESC, created_at DESC, id LIMIT 1)
        SELECT id, title, CASE status WHEN 'active' THEN '▶' WHEN 'completed' THEN '✓' WHEN 'archived' THEN '▦' ELSE '○' END AS icon, repeat('█', progress * 10 // 100) || repeat('░', 10 - progress * 10 // 100) AS bar FROM f""",
    "goal_progress": f"""WITH {_GOALS}, c AS (SELECT id, progress, len(list_filter({_MARKS}, lambda m: lower(m) = 'x')) AS done, len({_MARKS}) AS total FROM goal)
        SELECT id, CAST(done AS INTEGER) AS done, CAST(total AS INTEGER) AS total, CAST(CASE WHEN total > 0 THEN done * 100 // total ELSE progress END AS INTEGER) AS percent FROM c""",
    "goal_subtasks": rf"""WITH {_GOALS}, r AS (SELECT id, regexp_extract_all(coalesce(description, ''), '(?m)^\s*[-*+]\s+\[[ xX]\][^\n]*') AS l FROM goal),
        e AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM r)
        SELECT id, CAST(p AS INTEGER) AS position, lower(regexp_extract(line, '^\s*[-*+]\s+\[([ xX])\]\s*', 1)) = 'x' AS done, regexp_replace(regexp_replace(line, '^\s*[-*+]\s+\[([ xX])\]\s*', ''), '\s+$', '') AS task FROM e""",
    "timeline_range": """SELECT id, key, summary AS content, event_type AS summary, received_at AS created_at FROM timeline_events
        WHERE received_at BETWEEN TIMESTAMPTZ '2026-01-01 00:00:00+00' AND TIMESTAMPTZ '2026-02-01 00:00:00+00' ORDER BY received_at DESC, id DESC LIMIT 100""",
    "timeline_lines": """SELECT id, '[' || strftime(received_at AT TIME ZONE 'UTC', '%Y-%m-%d') || '] ' || coalesce(key, '') || ': ' || CASE WHEN length(summary) > 80 THEN left(summary, 80) || '…' ELSE coalesce(summary, '') END AS line FROM timeline_events""",
    "timeline_digest": f"""WITH {_GOALS}, page AS (SELECT *, row_number() OVER (ORDER BY received_at DESC, id DESC) AS k FROM timeline_events QUALIFY k <= 20)
        SELECT (SELECT count(*) FROM page) AS events, (SELECT count(*) FROM page) AS notes, (SELECT least(1000, count(*)) FROM goal WHERE status = 'active') AS goals,
        (SELECT coalesce(string_agg(coalesce(nullif(event_type, ''), nullif(summary, ''), key, ''), ' | ' ORDER BY k), '') FROM page WHERE k <= 5) AS first_items""",
    "tool_log": """SELECT command_id, call AS event_type, coalesce(nullif(key, ''), nullif(query, ''), nullif(goal_id, ''), '') AS key, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE coalesce(text, '') END AS summary FROM agent_commands""",
    "session_save": f"WITH {_SESSIONS} SELECT key, count(*) AS versions FROM saved GROUP BY key",
    "session_latest": f"WITH {_SESSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, n DESC) AS k FROM s) SELECT project, data, created_at FROM r WHERE k = 1",
    "session_list": f"WITH {_SESSIONS} SELECT DISTINCT 'session/project/' || split_part(key, '/', 3) || '/' AS entry FROM saved",
    "session_compact_count": f"WITH {_SESSIONS}, r AS (SELECT key, max(created_at) AS created_at FROM saved GROUP BY key) SELECT count(*) AS removed FROM r WHERE NOT (key LIKE '%/latest' OR created_at >= {_NOW} - INTERVAL 30 DAY)",
    "session_compact": f"WITH {_SESSIONS}, r AS (SELECT key, max(created_at) AS created_at FROM saved GROUP BY key) SELECT key FROM r WHERE key LIKE '%/latest' OR created_at >= {_NOW} - INTERVAL 30 DAY",
    "graph_edges": f"WITH {_EDGES} SELECT * FROM edge WHERE contains(src, 'NATION_1') OR contains(dst, 'NATION_1')",
    "graph_neighbours": f"""WITH {_EDGES}, e AS (SELECT * FROM edge WHERE contains(src, 'NATION_1') OR contains(dst, 'NATION_1') ORDER BY 'memory/graph/2026-01-01-' || src || '-' || dst || '-' || relation LIMIT 500)
        SELECT dst AS neighbour, relation, 'out' AS direction FROM e WHERE src = 'NATION_1' UNION ALL SELECT src, relation, 'in' FROM e WHERE dst = 'NATION_1'""",
    "graph_chains": f"WITH {_EDGES} SELECT DISTINCT x.src AS a, x.dst AS via, y.dst AS b FROM edge x JOIN edge y ON x.dst = y.src",
    "graph_reach": f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src AS x, dst AS y FROM edge UNION SELECT dst, src FROM edge), walk AS (
            SELECT (SELECT min(dst) FROM edge) AS entity, 0 AS hops UNION SELECT y, hops + 1 FROM walk JOIN b ON entity = x WHERE hops < 2
        ) SELECT entity, min(hops) AS hops FROM walk GROUP BY entity""",
    "context_memories": f"""WITH {_SCORES}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS rank FROM scored QUALIFY rank <= 8)
        SELECT CAST(rank AS INTEGER) AS rank, key, round(score, 6) AS score, coalesce(project, '') AS summary FROM top JOIN documents ON 'memory/vec/' || doc_id = key""",
    "context_reminders": f"""WITH {_KV} SELECT key, value FROM kv WHERE starts_with(key, 'memory/reminder/') AND key NOT LIKE '%/'
        AND (try_cast(split_part(key, '/', 3) AS DATE) IS NULL OR split_part(key, '/', 4) = '' OR try_cast(split_part(key, '/', 3) AS DATE) >= TIMESTAMP '2026-05-31 12:00:00')""",
    "resource_goals": f"""WITH {_GOALS}, f AS (SELECT * FROM goal WHERE status = 'active' ORDER BY priority DESC, created_at DESC, id LIMIT 1000)
        SELECT 'goals' AS section, CAST(row_number() OVER (ORDER BY priority DESC, created_at DESC, id) AS INTEGER) AS position,
        '▶ ' || rpad(CASE WHEN length(id) > 24 THEN left(id, 21) || '...' ELSE id END, 24, ' ') || ' P' || priority || ' [' || repeat('█', progress * 10 // 100) || repeat('░', 10 - progress * 10 // 100) || '] ' || lpad(progress::VARCHAR, 3, ' ') || '% ' ||
        CASE WHEN length(title) > 40 THEN left(title, 39) || '…' ELSE coalesce(title, '') END AS line FROM f""",
    "resource_timeline": """WITH t AS (SELECT * FROM timeline_events ORDER BY received_at DESC, id DESC LIMIT 50)
        SELECT 'timeline' AS section, CAST(row_number() OVER (ORDER BY received_at DESC, id DESC) AS INTEGER) AS position,
        '[' || strftime(received_at AT TIME ZONE 'UTC', '%Y-%m-%d') || '] ' || coalesce(key, '') || ': ' || CASE WHEN length(summary) > 80 THEN left(summary, 80) || '…' ELSE coalesce(summary, '') END AS line FROM t QUALIFY position <= 10""",
    "resource_insights": f"""WITH {_for(_CONTEXT, 1)}, seen AS (SELECT (SELECT count(*) FROM act) || ' goals, ' || (SELECT count(*) FROM late) || ' events' AS t)
        SELECT 'insights' AS section, CAST(k + 1 AS INTEGER) AS position, '{{"type":"insight","title":"' || t || '","description":"' || k || '","priority":' || k || '}}' AS line FROM seen, range(5) AS r(k)""",
    "suggest_prompt": f"""WITH {_for(_CONTEXT, 1)} SELECT 'Context: now' || chr(10)
        || 'Answer in the language ru. Suggest 3 things at most, as a JSON array of objects with type (reminder, followup, goal_next_step or insight), title, description and priority (0 to 10).' || chr(10) || chr(10) || 'Active goals:' || chr(10)
        || coalesce((SELECT string_agg(CASE WHEN progress >= 100 THEN '✓' ELSE '⏳' END || ' ' || coalesce(title, '') || ': ' || coalesce(description, '') || ' (progress: ' || coalesce(progress, 0) || '%, priority: ' || coalesce(priority, 0) || ')', chr(10) ORDER BY k) FROM act), '')
        || chr(10) || chr(10) || 'Recent activity:' || chr(10) || coalesce((SELECT string_agg(line, chr(10) ORDER BY k) FROM late), '') AS prompt""",
    "resource_awareness": f"""WITH {_for(_LINES, 10)} SELECT text
        || coalesce((SELECT chr(10) || chr(10) || '## Active Goals' || chr(10) || string_agg('- [' || coalesce(progress, 0) || '%] ' || coalesce(title, '') || ': ' || coalesce(description, '') || chr(10), '' ORDER BY k) FROM act), '')
        || coalesce((SELECT chr(10) || chr(10) || '## Recent Activity' || chr(10) || string_agg('- ' || line || chr(10), '' ORDER BY k) FROM late), '') AS text FROM whole""",
    "context_lines": f"WITH {_for(_LINES, 8)} SELECT * FROM lines",
    "context_text": f"WITH {_for(_LINES, 8)} SELECT text FROM whole",
    "context_counts": f"WITH {_for(_CONTEXT, 8)} SELECT (SELECT count(*) FROM top) AS total_count, (SELECT count(*) FROM hit) AS memories, (SELECT count(*) FROM act) AS goals",
    "question_answers": "SELECT CAST(command_id AS VARCHAR) AS id, CASE WHEN trim(coalesce(text, '')) <> '' THEN 'asked: ' || text END AS answer FROM agent_commands",
    "render_hits": f"""WITH {_for(_CONTEXT, 8)} SELECT rank || '. ' || CASE WHEN length(key) > 40 THEN left(key, 37) || '...' ELSE key END || ' (' || printf('%.0f', score * 100) || '%): '
        || CASE WHEN length(c) > 60 THEN left(c, 59) || '…' ELSE c END AS line FROM (SELECT *, regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g') AS c FROM hit)""",
    "render_cards": f"""WITH {_GOALS} SELECT id, CASE WHEN length(body) > 4000 THEN left(body, 4000) || chr(10) || '...' ELSE body END AS card FROM (
        SELECT id, '<b>' || {_HTML.format("coalesce(title, '')")} || '</b> ' || progress || '%' || chr(10) || {_HTML.format("coalesce(description, '')")} || chr(10)
            || {_HTML.format("CASE WHEN len(labels) > 0 THEN array_to_string(labels, ', ') ELSE '—' END")} || CASE WHEN coalesce(deadline, '') <> '' THEN chr(10) || {_HTML.format('deadline')} ELSE '' END AS body FROM goal)""",
    "classify": _CLASS,
    "greetings": f"""WITH t AS (
            SELECT command_id, CASE command_id % 3 WHEN 0 THEN text WHEN 1 THEN {GREETINGS}[command_id % {len(GREETINGS)} + 1] ELSE {GREETINGS}[command_id % {len(GREETINGS)} + 1] || ' ' || text END AS t, lang FROM agent_commands WHERE text IS NOT NULL
        ), l AS (SELECT *, lower(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS low FROM t)
        SELECT command_id, strlen(t) < 20 AND ({' OR '.join(f"low = '{g}' OR starts_with(low, '{g} ') OR starts_with(low, '{g}!') OR starts_with(low, '{g}?')" for g in GREETINGS)}) AS greeting,
        CASE WHEN lower(left(coalesce(lang, ''), 2)) IN ('', 'ru') THEN 'ru' ELSE 'en' END AS language FROM l""",
    "labels": f"SELECT command_id, coalesce(array_to_string({_labels('labels')}, ','), '') AS labels, CASE WHEN len({_labels('labels')}) > 0 THEN array_to_string({_labels('labels')}, ', ') ELSE '—' END AS shown FROM agent_commands",
    "text_forms": """SELECT command_id, CASE WHEN length(text) > 20 THEN left(text, 20) || '…' ELSE text END AS cut, CASE WHEN length(text) > 30 THEN left(text, 30) || '...' ELSE text END AS dots,
        CASE WHEN length(text) > 25 THEN left(text, 24) || '…' ELSE text END AS within, CASE WHEN length(text) > 24 THEN left(text, 21) || '...' ELSE text END AS short,
        replace(replace(replace(text || ' <&>', '&', '&#38;'), '<', '&#60;'), '>', '&#62;') AS html, CASE WHEN length(repeat(text, 60)) > 4000 THEN left(repeat(text, 60), 4000) || '...' ELSE repeat(text, 60) END AS prompt FROM agent_commands""",
    "json_repair": r"""SELECT command_id, '[{"title":"' || regexp_replace(text, '[",}\]]', '', 'g') || '","type":"note"}]' AS json FROM agent_commands""",
    "suggestions": r"""SELECT command_id, 'note' AS type, regexp_replace(text, '[",}\]\\\[]', '', 'g') AS title, 3 AS priority FROM agent_commands""",
    "model_replies": "SELECT command_id, answer AS reply FROM agent_commands WHERE answer IS NOT NULL",
    "agent_commands": """SELECT command_id, CASE WHEN command_id % 4 < 3 THEN call END AS call, CASE WHEN command_id % 4 < 3 THEN text END AS text, CASE WHEN command_id % 4 = 3 THEN text END AS answer FROM agent_commands""",
    "conversations": "SELECT command_id AS id, 'User: ' || coalesce(text, '') || chr(10) || 'Assistant: ' || coalesce(answer, '') || chr(10) AS text FROM agent_commands WHERE coalesce(text, '') <> '' OR coalesce(answer, '') <> ''",
    "extracted_facts": "SELECT 'memory/auto/2026-06-01/' || left(md5(text), 8) AS key, text AS content, 'echo' AS summary, 'auto-extract' AS source FROM agent_commands WHERE text IS NOT NULL",
}


#: Timestamps of results, given in micros since 1970 as the queries do.
_TIMES = {
    "kv_current": ("created_at", "modified_at"), "kv_put": ("created_at", "modified_at"), "kv_delete": ("created_at",), "kv_get": ("created_at", "modified_at"), "kv_info": ("created_at", "modified_at"),
    "find": ("created_at",), "find_cyrillic": ("created_at",), "goal_current": ("created_at", "updated_at"), "goal_update": ("updated_at",), "timeline_range": ("created_at",), "session_latest": ("created_at",),
}
ORACLE |= {name: f"SELECT * REPLACE ({', '.join(f'epoch_us({c}) AS {c}' for c in cols)}) FROM ({ORACLE[name]})" for name, cols in _TIMES.items()}
