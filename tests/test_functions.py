import pytest
from pyspark.sql import functions as F

from cairn.functions import durations, messages, text
from cairn.operators import dig


def one(spark, value, f, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("x")).alias("y")).first()["y"]


def test_labels(spark):
    assert one(spark, [" bug ", "", "ops", "bug", " deploy ", None], text.clean_labels, "x array<string>") == ["bug", "ops", "deploy"]
    assert one(spark, "bug, ops,bug,, deploy", text.given_labels) == ["bug", "ops", "deploy"]
    assert one(spark, '["bug","ops","bug"," deploy "]', text.given_labels) == ["bug", "ops", "deploy"]
    assert one(spark, '["bug",', text.given_labels) is None
    assert one(spark, "  ", text.given_labels) == []
    assert one(spark, "nonsense", text.stored_labels) == []
    assert one(spark, '["a","b"]', text.loose_labels) == ["a", "b"]
    assert one(spark, '"[\\"a\\",\\"b\\"]"', text.loose_labels) == ["a", "b"]
    assert one(spark, '"a, b,"', text.loose_labels) == ["a", "b"]
    assert one(spark, "a, b", text.loose_labels) == ["a", "b"]


def test_subtasks(spark):
    three = "- [x] one\n- [ ] two\n  * [X] three\ntext\n+ [x] four\n- [ ] five"
    marks = one(spark, three, text.subtask_marks)
    assert (len([m for m in marks if m.lower() == "x"]), len(marks)) == (3, 5)
    assert one(spark, "- [x] Task A\n- [ ] Task B\n- [x] Task C", lambda c: text.subtask_progress(c, F.lit(-1))) == 66
    assert one(spark, "- [x] a\n- [ ] b\n- [x] c\n- [ ] d", lambda c: text.subtask_progress(c, F.lit(-1))) == 50
    assert one(spark, None, lambda c: text.subtask_progress(c, F.lit(7))) == 7


def test_cuts(spark):
    assert one(spark, "hello world", lambda c: text.cut(c, 8)) == "hello wo…"
    assert one(spark, "exactly", lambda c: text.cut(c, 7)) == "exactly"
    assert len(one(spark, "x" * 5000, text.prompt_cap)) == 4003
    assert one(spark, "a<b>&c", text.escape_html) == "a&#60;b&#62;&#38;c"


def test_first_letters():
    assert [text.upper_first(x) for x in ("архив", "ёж", "find", "été", "über", "")] == ["Архив", "Ёж", "Find", "été", "über", ""]
    assert text.keyword_patterns("Backup") == ["%backup%"]
    assert text.keyword_patterns("архив") == ["%архив%", "%Архив%"]


def test_like(spark):
    hit = lambda t, k: one(spark, t, lambda c: text.like_any(c, text.keyword_patterns(k)))
    assert hit("The BACKUP ran", "backup") and hit("Архив", "архив") and not hit("АРХИВ", "архив")
    assert hit("a\\b", "a\\b") and not hit("ab", "a\\b")
    assert hit("a-b", "a_b") and hit("axxb", "a%b") and not hit("É", "é")


def test_durations(spark):
    assert [durations.seconds(x) for x in ("", "1d", "90m", "1h30m", "500ms", "-2h", "abc", "xd")] == [7200, 86400, 5400, 5400, 0.5, -7200, None, None]
    assert durations.window_seconds("abc") == 7200
    for given, wanted in ((0, "+0m"), (59, "+0m"), (-60, "-1m"), (3661, "+1h1m"), (-7325, "-2h2m")):
        assert one(spark, given, durations.delta_text, "x bigint") == wanted


def test_messages(spark):
    kind = lambda t: one(spark, t, messages.classify)
    assert kind("findings of the day")["type"] == "question"
    assert kind("is it so?")["type"] == "question"
    assert (kind("please, show goals")["type"], kind("please, show goals")["command"]) == ("command", "goals")
    assert kind("address the issue")["type"] == "goal"
    assert kind("нужно сделать, не срочно")["priority"] == 9
    assert kind("нужно потом")["priority"] == 2
    note = kind("  Bread\n and milk #Food, #food #- #shop_list! ")
    assert (note["type"], note["title"], note["description"], note["labels"]) == ("note", "Bread", "and milk #Food, #food #- #shop_list!", ["food", "-", "shop_list"])
    assert one(spark, "Привет!", messages.is_greeting) and not one(spark, "history", messages.is_greeting)


def test_replies(spark):
    for body, wanted in (
        ('{"choices":[{"message":{"content":"hi"}}]}', "hi"),
        ('{"message":{"content":"hi"}}', "hi"),
        ('{"response":"hi"}', "hi"),
        ('{"message":{"content":"hel"}}\n{"message":{"content":"lo"}}\n', "hello"),
        ('{"choices":[{"delta":{"content":"hi"}}]}', "hi"),
        ("garbage", None),
    ):
        assert one(spark, body, text.reply_text) == wanted
    assert one(spark, '{"error":{"message":"no"}}', text.reply_error) == "no"


def test_durations_of_columns_and_of_texts_are_the_same(spark):
    texts = ["", "0", "-0", "30m", "1h30m", "500ms", "1.5h", "-2s", "+3us", ".5s", "1.s", "7ns", "2d", "-1d", " 3d", "1h2d", "x", "5", "h", "1x", "1d2h", "-", "d", "1µs"]
    got = {r["t"]: r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", durations.seconds_of(F.col("t")).alias("s")).collect()}
    for x in texts:
        wanted = durations.seconds(x)
        assert (got[x] is None) == (wanted is None) and (wanted is None or abs(got[x] - wanted) < 1e-9), x


def test_arguments_of_a_dig():
    assert dig.arguments("backup plan --keywords graph,,queue --window 2h --max 5") == {"query": "backup plan", "keywords": ["graph", "queue"], "window": "2h", "limit": 5}
    assert dig.arguments('"a  b" --max=3') == {"query": "a  b", "keywords": [], "window": "", "limit": 3} and dig.arguments("")["query"] == ""
    for bad in ("a --what 1", "a --max", "a --max x", 'a "b'):
        with pytest.raises(ValueError):
            dig.arguments(bad)
