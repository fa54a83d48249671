import pytest

from cairn.llm import cutoffs
from cairn.llm.cutoffs import cut_by_source, cut_texts, ending

WHOLE = "The queue sorts the archived notes before the morning review. The browser checks the settings folder."


def run(spark, rows):
    full = [(100 + i, WHOLE, "web") for i in range(3)] + [(110 + i, "done.\n#memory #project\n", "web") for i in range(3)]
    df = spark.createDataFrame([(*r, "x", "y") for r in [*rows, *full]], "doc_id bigint, text string, source string, node string, known string")
    return df, {r["doc_id"]: r["why"] for r in cut_texts(df).collect()}


def test_cuts(spark):
    rows = [
        (1, "The queue sorts the arch", "web"), (2, "The queue sorts the archived", "web"), (3, "The queue sorts the arch…", "web"), (4, "The queue sorts the archived [...]", None), (5, "It is sorted, and �", "web"),
        (6, "See:\n```\nexport LIMI", "web"), (7, "The queue sorts the notes,", "web"), (8, "Again the arch", "web"), (8, "Again the arch", "web"),
        (20, "Done. To be continued…", "web"), (21, "Done.\n#memory #project", "web"), (22, "Done.\n— Queue bot", "web"), (23, "Done.\nmemory/project/queue/notes", "web"), (24, "Done.\n- [x] The notes (Queue)", "web"),
        (25, "Done.\n```\nx = 1\n```", "web"), (26, "Done. ✅", "web"), (27, "Done.\nv1.2.3", "web"), (28, None, "web"), (29, "", "web"), (30, "Is it?", "web"), (31, "word. " * 40_000, None), (31, "word. " * 40_000, None), (32, " \n ", "web"),
    ]
    df, got = run(spark, rows)
    assert got == {1: "word", 2: "sentence", 3: "word", 4: "sentence", 5: "character", 6: "code", 7: "sentence", 8: "word"}
    assert cut_texts(df).count() == 9
    by = {r["source"]: (r["texts"], r["cut"]) for r in cut_by_source(df, cut_texts(df)).collect()}
    assert by[None] == (3, 1) and by["web"][1] == 8


def test_keys_cut_at_a_limit(spark):
    cut = ("The notes. " * 30)[:188] + "\nmemory/proj"
    whole = ("The notes. " * 30)[:180] + "\nmemory/proj"
    rows = [(i, ("The queue sorts the archived project notes. " * 9)[:199] + ".", "lim") for i in range(1, 9)]
    _, got = run(spark, [*rows, (50, cut, "lim"), (51, whole, "lim"), (52, cut.replace("proj", "note") + "s", "lim")])
    assert got.get(50) == "word" and 51 not in got and 52 not in got


def test_each_part_of_the_evidence_decides_rows(spark, monkeypatch):
    text = "The queue sorts the archived notes. " * 12
    rows = [(i, text[: 195 if i % 2 else 205] + "...", "lim") for i in range(1, 13)]  # limits of 198, after a word, and of 208, in one
    rows += [(20 + i, text[: 100 + 13 * i] + ".", "lim") for i in range(9)] + [(40, "Done. We shall see…", "lim"), (41, "See the arch…", "other"), (42, "See the archived…", "other"), (43, "See the archived", "other")]
    rows += [(60 + i, text[:240] + "é" * i + " x" * (20 - i) + "...", "octets") for i in range(10)]

    def found():
        return set(run(spark, rows)[1])

    all_ = found()
    assert {1, 3, 5, 41, 43} <= all_ and not {40, 42} & all_
    for name, value, lost in (("PREFIX", 0.0, 41), ("AT_LIMIT", 0.0, 1), ("ENDS", dict.fromkeys(cutoffs.ENDS, 0.0), 43)):
        with monkeypatch.context() as m:
            m.setattr(cutoffs, name, value)
            assert lost not in found()


def test_empty(spark):
    assert cut_texts(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


@pytest.mark.parametrize("text, kind", [("a.", "closed"), ("a…", "mark"), ("a b", "open"), ("#a #b", "line"), ("— X bot", "line"), ("(a)", "closed"), ("a,", "open"), ("end. …", "closed"), ("a [...]", "omission")])
def test_endings(text, kind):
    assert ending(text)[0] == kind
