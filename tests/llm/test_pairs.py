from collections import Counter
from itertools import combinations

import numpy as np

from cairn.llm.pairs import clean_items, co_occurrence, label_items, pack_pairs
from pyspark.sql import functions as F


def frame(spark, baskets):
    return spark.createDataFrame([(b, i) for i, b in enumerate(baskets)], "items array<string>, n int")


def test_counts_and_odds(spark):
    baskets = [["a", "b"]] * 5 + [["a", "c"]] * 2 + [["d"]] * 20 + [["b", "a", "d"]] + [[], None]
    got = {(r["item_a"], r["item_b"]): r for r in co_occurrence(frame(spark, baskets), 2, 0.0).collect()}
    assert set(got) == {("a", "b"), ("a", "c")}
    r = got["a", "b"]
    assert (r["n_ab"], r["n_a"], r["n_b"], r["n"]) == (6, 8, 6, 28) and abs(r["lift"] - 6 * 28 / 48) < 1e-9
    assert abs(r["log_odds"] - np.log(6.5 * 20.5 / (2.5 * 0.5))) < 1e-9


def test_rule_is_exact_at_its_bounds(spark):
    # c(a,b) * n = 3 * c(a) * c(b): 4 * 12 = 3 * 4 * 4
    baskets = [["a", "b"]] * 4 + [["c"]] * 8
    assert co_occurrence(frame(spark, baskets), 3, 0.001, 3.0).count() == 1
    assert co_occurrence(frame(spark, [["a", "b"]] * 4 + [["c"]] * 7), 3, 0.001, 3.0).count() == 0
    assert co_occurrence(frame(spark, [["a", "b"]] * 2 + [["c"]] * 100), 3, 0.001, 3.0).count() == 0


def test_empty(spark):
    assert co_occurrence(frame(spark, []).limit(0), 3, 0.001, 3.0).count() == 0
    assert co_occurrence(frame(spark, [[], None]), 3).count() == 0


def test_all_pairs_of_long_and_short_baskets():
    g = np.random.default_rng(0)
    baskets = [g.choice(2000, k, replace=False) for k in (2, 3, 3, 600, 1, 0)]
    ids, offsets = np.concatenate(baskets).astype(np.int64), np.concatenate([[0], np.cumsum([len(b) for b in baskets])])
    got = Counter(int(c) for part in pack_pairs(ids, offsets) for c in part)
    wanted = Counter((min(x, y) << 32) | max(x, y) for b in baskets for x, y in combinations(map(int, b), 2))
    assert got == wanted


def test_items(spark):
    rows = [(1, ["#Bug", " bug ", "", None, "##x", " "], '["A", " a", null]'), (2, None, "x, #Y ,,x"), (3, [], "[bad"), (4, ["ß"], None)]
    df = spark.createDataFrame(rows, "id int, tags array<string>, labels string").select(clean_items(F.col("tags")).alias("t"), clean_items(label_items(F.col("labels"))).alias("l"))
    assert [(r["t"], r["l"]) for r in df.collect()] == [(["bug", "x"], ["a"]), (None, ["x", "y"]), ([], None), (["ß"], None)]
