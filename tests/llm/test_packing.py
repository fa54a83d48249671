import os

import numpy as np
import pytest

from cairn.llm.packing import TOKENIZER, assign, fill, pack, repeat_counts, tokenizer

needs_files = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")


@pytest.mark.parametrize("capacity, high", [(256, 256), (512, 300), (4096, 400), (7, 7)])
def test_packings_are_valid_and_full(capacity, high):
    g = np.random.default_rng(1)
    items = g.integers(1, high, 3000)
    where = pack(items, capacity)
    used = np.bincount(where, weights=items)
    assert (where >= 0).all() and used.max() <= capacity and used.min() > 0
    assert len(used) <= 1.02 * np.ceil(items.sum() / capacity) + 1


def test_one_of_each():
    assert pack(np.array([5]), 5).tolist() == [0]
    assert sorted(np.bincount(pack(np.array([3, 2, 3, 2]), 5), weights=[3, 2, 3, 2]).tolist()) == [5, 5]
    assert len(pack(np.array([], int), 5)) == 0


def test_least_squares():
    x = repeat_counts([{3: 1, 2: 1}, {3: 1}], {3: 10, 2: 4})
    assert abs(x[0] - 4) < 0.2 and abs(x[1] - 6) < 0.2


@needs_files
def test_tables(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 5000), (5, "a"), (5, "a"), (6, "ещё слово")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n int, uid string")
    got = assign(docs, [16, 64, None, 0, -5, 16])
    n = {i: tokenizer(TOKENIZER)(t) for i, t in rows if t}
    per = {(r["capacity"], r["container"]): 0 for r in got.collect()}
    for r in got.collect():
        per[r["capacity"], r["container"]] += r["tokens"]
    assert all(v <= c for (c, _), v in per.items())
    for c in (16, 64):
        parts = sorted((r["start_token"], r["tokens"]) for r in got.where(f"capacity = {c} and doc_id = 4").collect())
        assert sum(t for _, t in parts) == n[4] and all(a + t == b for (a, t), (b, _) in zip(parts, parts[1:]))
        assert sum(r["tokens"] for r in got.where(f"capacity = {c} and doc_id = 5").collect()) == 2 * n[5]
    assert {r["doc_id"] for r in got.collect()} == {1, 4, 5, 6}
    assert all(r["used"] > 0.8 for r in fill(got).where("capacity = 16").collect())
    assert assign(docs.limit(0), [16]).count() == 0 and assign(docs, []).count() == 0
