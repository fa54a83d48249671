from cairn.llm.leaks import WINDOW, item_texts, leaked_items, plain_words

ITEM = "Velximund and Belilfax split 9105 seed packets after supper in the old barn before the rain. Answer with one number only."
OTHER = "A keeper of bees counts three hundred wool spools in a rusty locker at dawn. Answer with one number only."


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, word string")
    i = spark.createDataFrame([(*r, "x", "y") for r in items], "item_id bigint, text string, words string, number string")
    return {(r["doc_id"], r["item_id"]): r["windows"] for r in leaked_items(d, i).collect()}


def test_leaks(spark):
    part = "split 9105 seed packets after supper in the"
    docs = [
        (1, f"Note: {part} end"), (2, "split 9105 seed packets after supper in"), (3, f"**SPLIT** `9105`,\n seed​ pack­ets <b>after</b> supper… in&nbsp;the"), (4, "Answer with one number only. " * 5),
        (5, ITEM + "\n" + OTHER), (6, None), (7, ""), (8, "x " * 50_000 + part), (8, part), (9, "split 9105 seed packets after lunch supper in the"), (10, "split 9105 seed pac-\nkets after supper in the"),
    ]
    got = run(spark, docs, [(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "too short. Answer with one number only.")])
    assert set(got) == {(1, 1), (3, 1), (5, 1), (5, 2), (8, 1), (10, 1)}
    own = plain_words(ITEM.replace("Answer with one number only.", ""))
    assert got[1, 1] == 1 and got[5, 1] == len(own) - WINDOW + 1


def test_a_standing_instruction_is_no_text_of_an_item(spark):
    rows = [(1, ITEM, "x"), (2, OTHER, "x"), (3, "One sentence alone", "x"), (4, "First. A last one of its own", "x"), (5, None, "x"), (6, " ", "x")]
    got = {r["item_id"]: r["words"] for r in item_texts(spark.createDataFrame(rows, "item_id long, text string, last string")).collect()}
    assert got[1].endswith("before the rain") and got[2].endswith("at dawn") and got[3] == "one sentence alone" and got[4].endswith("its own") and set(got) == {1, 2, 3, 4}


def test_an_item_in_a_third_of_the_documents(spark):
    part = " ".join(plain_words(ITEM)[:10])
    docs = [(i, f"note {i} {part} and more" if i % 3 == 0 else f"plain note {i}") for i in range(3000)]
    assert run(spark, docs, [(1, ITEM), (2, OTHER)]) == {(i, 1): 3 for i in range(0, 3000, 3)}


def test_brute_force(spark):
    import random

    g = random.Random(3)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(g.choices(vocabulary, k=20))) for i in range(5)]
    docs = [(i, " ".join(g.choices(vocabulary, k=30) + items[i % 5][1].split()[k : k + 9])) for i in range(40) for k in [g.randint(0, 14)]]
    windows = [(i, x.split()[k : k + WINDOW]) for i, x in items for k in range(20 - WINDOW + 1)]
    wanted = {(d, i) for d, t in docs for i, w in windows if " ".join(w) in f" {t} " and f" {' '.join(w)} " in f" {t} "}
    assert set(run(spark, docs, items)) == wanted


def test_empty(spark):
    assert run(spark, [], [(1, ITEM)]) == {} and run(spark, [(1, ITEM)], []) == {}
    assert plain_words(None) == [] and plain_words("ﬁne") == ["fine"]
