import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm.languages import LANGUAGES, LanguageModel, fit_languages, label_language, mislabelled, segment, sentences, text_languages

WORDS = {
    "en": "the queue sorts every note after each import while the team waits for more records and nothing else happens there",
    "de": "die warteschlange sortiert jede notiz nach jedem import während das team auf weitere sätze wartet und sonst nichts geschieht",
    "fr": "la file trie chaque note après chaque import tandis que l'équipe attend encore des fiches et rien d'autre ne se passe",
    "es": "la cola ordena cada nota después de cada carga mientras el equipo espera otros registros y no pasa nada más allí",
    "pt": "a fila ordena cada nota depois de cada importação enquanto a equipa espera mais registos e não acontece nada ali",
    "ru": "очередь сортирует каждую заметку после каждого импорта пока команда ждёт ещё записей и больше ничего не происходит",
    "uk": "черга впорядковує кожну нотатку після кожного імпорту поки команда чекає ще записів і більше нічого не відбувається",
}


def sentence(lang, g):
    w = WORDS[lang].split()
    return " ".join(w[k] for k in sorted(g.sample(range(len(w)), 10))) + "."


@pytest.fixture(scope="module")
def model():
    g = random.Random(1)
    rows = [(sentence(lang, g), lang) for lang in LANGUAGES for _ in range(60)]
    rows += [(sentence("ru", g), "en") for _ in range(4)]  # wrong labels
    return LanguageModel.fit([sentences(t)[0] for t, _ in rows], [lang for _, lang in rows])


def test_held_out_accuracy(model):
    g = random.Random(2)
    rows = [(sentence(lang, g), lang) for lang in LANGUAGES for _ in range(40)]
    got = [s[0][1] for s in segment(model, [t for t, _ in rows])]
    assert np.mean([a == b for a, (_, b) in zip(got, rows)]) > 0.98


def test_segments(model):
    g = random.Random(3)
    mixed = " ".join([sentence("en", g), sentence("en", g), sentence("uk", g), sentence("en", g)])
    first, none, empty, wordless, short, long = segment(model, [mixed, None, "", "123 !!", "queue notes", " ".join(sentence("fr", g) for _ in range(2000))])
    assert [s[1] for s in first] == ["en", "uk", "en"] and all(0.5 < s[3] <= 1 for s in first)
    assert none == empty == wordless == [] and len(short) == 1 and [s[1] for s in long] == ["fr"]


def test_tables(spark, model):
    g = random.Random(4)
    rows = [(1, "en", sentence("en", g)), (2, None, sentence("de", g)), (3, "fr", sentence("es", g)), (4, "ru", sentence("ru", g) + " " + sentence("en", g)), (5, None, None), (6, None, ""), (7, "pt", sentence("pt", g)), (7, "pt", sentence("pt", g))]
    t = spark.createDataFrame([("t", *r, "x") for r in rows], "src string, row_id bigint, label string, text string, lang string")
    assert sorted((r["row_id"], r["lang"]) for r in mislabelled(t, model).collect()) == [(2, "de"), (3, "es"), (4, "en"), (4, "ru")]
    assert text_languages(t, model).count() == 7
    assert mislabelled(t.limit(0), model).count() == 0


def test_fit_from_a_table(spark):
    g = random.Random(5)
    rows = [(sentence(lang, g), lang) for lang in LANGUAGES for _ in range(30)] + [(None, "en"), ("x", None)]
    m = fit_languages(spark.createDataFrame(rows, "text string, lang string"), 20)
    assert segment(m, [sentence("uk", g)])[0][0][1] == "uk"


def test_labels(spark):
    forms = {"en_GB": "en", "EN": "en", " eng ": "en", "English": "en", "русский": "ru", "Deutsch": "de", "fr-CA": "fr", "UK": "uk", "por": "pt", "xx": None, "und": None, "n/a": None, "": None, None: None, "auto": None}
    got = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, x string").orderBy("i").select(label_language(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == list(forms.values())


def test_noise_is_no_language():
    assert sentences("See memory/project/x #tag. Next\n```\nSELECT key\n```\n4fe54f7a done") == [["see"], ["next"], ["done"]]
