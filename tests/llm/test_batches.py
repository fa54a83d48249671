from collections import Counter
from datetime import datetime

import pytest

from cairn.llm import batches
from cairn.llm.batches import StatementIndex, close, grams, is_name, letter_weights, repeated_facts, repeats

T = datetime(2026, 1, 1)
SCHEMA = "fact_id bigint, batch_id int, content string, summary string, block string, sig string"
NAMES = ["Zelanmora", "Quinilria", "Velorlex", "Thalenix", "Coranmund", "Zelarlex", "Quinanmora", "Velanria", "Thalormund", "Corilnix", "Zelilnix", "Quinormund"]


def text(name, number, extra=""):
    return f"The extraction queue sorts raw meeting notes while the queue is idle, because {name} grew past {number} rows{extra}."


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(i + 1, 0, f"Архиватор сессий шифрует таблицу векторов и {n} сообщает о {1000 + i} изменениях") for i, n in enumerate(NAMES)]
    rows += [(20 + i, 0, f"the backup task copies old session snapshots number {i} for the whole team and reports changes") for i in range(6)]
    rows += [(30, 1, text("Zelanmora", 5)), (31, 1, text("Zelanmora", 5)), (32, 2, text("zelanmora", 5, " again").lower()), (33, 2, text("Quinilria", 5)), (34, 2, text("Zelanmora", 6))]
    rows += [(35, 3, text("Zelanmora", 5).replace("queue", "queeu")), (36, 3, None), (37, 3, ""), (38, 3, "..."), (39, 3, "no number in this plain sentence at all"), (40, 4, "no number in this plain sentence at last"), (41, None, "odd batch of one")]
    rows += [(42, 4, "x " * 30_000), (43, 4, "x " * 30_000)]
    return spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)


def test_repeats(facts):
    got = {(r["first_id"], r["fact_id"]) for r in repeated_facts(facts).collect()}
    assert got == {(30, 31), (30, 32), (30, 35), (39, 40), (42, 43)}


def test_empty(spark):
    assert repeated_facts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_reopened_index_knows_its_history(spark, facts, tmp_path):
    path = str(tmp_path / "index")
    for b in (0, 1, 2):
        StatementIndex(spark, path).add(facts.where(f"batch_id = {b}"))
    size = StatementIndex(spark, path).postings().read().count()
    moved = facts.where("batch_id = 0").withColumn("fact_id", facts["fact_id"] + 100)
    index = StatementIndex(spark, path)
    again = {(r["first_id"], r["fact_id"]) for r in index.add(moved).collect()}
    known = {r["fact_id"] for r in facts.where("batch_id = 0").collect()}
    assert again == {(i, i + 100) for i in known}
    assert StatementIndex(spark, path).postings().read().count() == size
    with pytest.raises(ValueError):
        StatementIndex(spark, path, similarity=0.8)


def test_a_probe_reads_the_same_files_however_long_the_history(spark):
    def fact(i):
        return (i, f"item{i}a item{i}b item{i}c item{i}d reports {i + 100000}")

    def read(history):
        index = StatementIndex(spark, per_bucket=20)
        index.add(spark.createDataFrame([fact(i) for i in range(history)], "fact_id bigint, content string"))
        index.add(spark.createDataFrame([(10**6, fact(3)[1] + " again")], "fact_id bigint, content string"))
        return len(index.read_files), len(index.postings().runs[0]["held"])

    small, large = read(60), read(600)
    assert large[1] > 4 * small[1]
    assert large[0] <= small[0] + 2 <= 8


def test_a_failed_batch_changes_nothing(spark, facts, monkeypatch):
    index = StatementIndex(spark)
    index.add(facts.where("batch_id = 1"))
    before = index.state
    monkeypatch.setattr(batches, "linked_ids", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(facts.where("batch_id = 2"))
    monkeypatch.undo()
    assert index.state == before
    assert (30, 32) in {(r["first_id"], r["fact_id"]) for r in index.add(facts.where("batch_id = 2")).collect()}


def test_a_growing_index_is_keyed_anew_and_merged(spark):
    rows = [(i, i // 20, f"w{i % 70}a w{i % 70}b w{i % 70}c w{i % 70}d w{i % 70}e {i % 70}") for i in range(100)]
    facts = spark.createDataFrame(rows, "fact_id bigint, batch_id int, content string")
    index = StatementIndex(spark, per_bucket=30)
    found = set()
    for b in range(5):
        found |= {(r["first_id"], r["fact_id"]) for r in index.add(facts.where(f"batch_id = {b}")).collect()}
    assert found == {(i % 70, i) for i in range(70, 100)}
    assert len(index.state["postings"]) < 4 and len(index.state["words"]) < 4


def test_variants_of_variants_are_repeats(spark):
    base = [f"w{c}" for c in "abcdefghijklmnopqrst"]
    chain = [" ".join([*(f"z{c}" for c in "abcdefghijklmnopqrst"[:k]), *base[k:], "7"]) for k in (0, 4, 8, 12)]
    rows = [(1 + i, i // 2, t) for i, t in enumerate(chain)] + [(9, 2, chain[3]), (10, 2, chain[0])]
    got = repeated_facts(spark.createDataFrame(rows, "fact_id bigint, batch_id int, content string"))
    assert {(r["first_id"], r["fact_id"]) for r in got.collect()} == {(1, 2), (1, 3), (1, 4), (1, 9), (1, 10)}


def test_one_number_in_all_facts_is_no_single_block(spark, monkeypatch):
    rows = [(i + 1, i // 40, f"w{i % 60}a w{i % 60}b w{i % 60}c w{i % 60}d {'x' if i < 60 else 'y'} 2026") for i in range(80)]
    facts = spark.createDataFrame(rows, "fact_id bigint, batch_id int, content string")
    index = StatementIndex(spark)
    index.add(facts)
    assert max(r["count"] for r in index.postings().read().groupBy("block").count().collect()) <= 2
    monkeypatch.setattr(batches, "HOT", 1)
    assert {(r["first_id"], r["fact_id"]) for r in repeated_facts(facts).collect()} == {(i, i + 60) for i in range(1, 21)}


def test_names():
    plain = ["because", "queue", "notes", "sorts", "while", "idle", "grew", "rows", "index", "team"]
    slots = sorted({g for w in [*(n.lower() for n in NAMES), *plain] for g in grams(w)})
    count = lambda words, g: sum(g in grams(w) for w in words)
    weights = letter_weights([(g, count([n.lower() for n in NAMES], g), count(plain, g)) for g in slots], len(NAMES), len(plain))
    assert is_name("zelormund", 0, 0, 1, weights) and not is_name("because", 0, 0, 0, weights)
    assert is_name("abcdef", 3, 0, 5, None)  # Latin in Cyrillic texts
    assert not is_name("zelormund", 3, 9, 1, weights)  # mostly in small letters
    assert not is_name("ivo", 9, 0, 9, weights) and not is_name("слово", 9, 0, 9, weights)


def test_pairs():
    words = lambda s: Counter(s.split())
    names = frozenset(["zelanmora", "zelormund"])
    a = words("the queue sorts notes while zelanmora grew past 5 rows")
    assert repeats(a, words("the queue sorts notes while zelanmora grew past 5 rwos"), names, 0.65)
    assert not repeats(a, words("the queue sorts notes while zelormund grew past 5 rows"), names, 0.65)
    assert not repeats(a, words("the queue sorts notes while zelanmora grew past 6 rows"), names, 0.65)
    assert not repeats(a, words("the queue zelanmora 5"), names, 0.65)
    assert close("below", "beolw") and not close("below", "above")


def test_waiting_batches_are_taken_in_together(spark, monkeypatch):
    rows = [(i, 0 if i < 40 else 1 + (i - 40) // 6, f"fact {i}") for i in range(106)]
    calls = []
    monkeypatch.setattr(StatementIndex, "add", lambda self, batch: calls.append({r["fact_id"] for r in batch.collect()}) or batch.selectExpr("fact_id as first_id", "fact_id"))
    assert repeated_facts(spark.createDataFrame(rows, "fact_id bigint, batch_id int, content string")).count() == 106
    assert calls == [set(range(40)), set(range(40, 76)), set(range(76, 106))]
    # A smaller id in a later batch is no earlier fact: such batches stay apart.
    assert batches.taken_together([(0, 1, 40, 40), (1, 41, 50, 10), (2, 45, 60, 9), (3, 61, 70, 10)]) == [(0, 0), (1, 1), (2, 3)]


def test_many_texts_of_one_key_are_compared_in_tiles_like_pairs(spark, monkeypatch):
    rows = [(i, f"Zelanmora keeps some quite old plain notes about backups {'abcdefgh'[i]}x 7") for i in range(8)] + [(8, "Zelanmora keeps some quite old plain notes about backups ax 8")]
    facts = spark.createDataFrame(rows, "fact_id bigint, content string")
    assert {(r["first_id"], r["fact_id"]) for r in StatementIndex(spark).add(facts).collect()} == {(0, i) for i in range(1, 8)}
    monkeypatch.setattr(batches, "PAIRED", 3)
    index = StatementIndex(spark)
    assert {(r["first_id"], r["fact_id"]) for r in index.add(facts).collect()} == {(0, i) for i in range(1, 8)}
    assert not [r["word"] for r in index.words().read().collect() if r["word"].isdigit()]
