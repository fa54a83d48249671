import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from cairn.llm.near import NearDuplicates, _bucket_pairs, components, sample
from cairn.llm.words import tokens

WORDS = [f"w{i}" for i in range(400)]


def brute(rows, least, size=1):
    sets = {i: set(tokens(t, size)) for i, t in rows if t and tokens(t, size)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-12}


def texts(n, seed=1):
    g = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and g.random() < 0.4:
            w = g.choice(rows)[1].split()
            for _ in range(g.randint(0, 4)):
                w[g.randrange(len(w))] = g.choice(WORDS)
            g.shuffle(w)
        else:
            w = g.choices(WORDS, k=g.randint(20, 40))
        rows.append((i, " ".join(w)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "id bigint, text string, sig int, doc string")


def test_recall_and_exactness(spark):
    rows = texts(400)
    wanted = brute(rows, 0.65)
    got = {(r["a"], r["b"]) for r in NearDuplicates(frame(spark, rows), 0.65, 1).pairs().collect()}
    assert got <= wanted
    assert len(got) >= 0.9 * len(wanted) > 20


def test_pairs_near_the_threshold_are_found(spark):
    rows = [(2 * i + k, " ".join(f"p{i}w{j}" for j in range(4 * k, 20 + 4 * k))) for i in range(60) for k in (0, 1)]
    wanted = brute(rows, 0.65)
    got = {(r["a"], r["b"]) for r in NearDuplicates(frame(spark, rows), 0.65, 1).pairs().collect()}
    assert len(wanted) == 60 and got <= wanted
    assert len(got) >= 36, len(got)


def test_shingles_of_five(spark):
    base = " ".join(WORDS[:60])
    rows = [(1, base), (2, base + " w399"), (3, " ".join(reversed(base.split()))), (4, "w1 w2")]
    got = {(r["a"], r["b"]) for r in NearDuplicates(frame(spark, rows)).pairs().collect()}
    assert got == {(1, 2)} == brute(rows, 0.8, 5)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " !? "), (4, "same text here"), (5, "Same, text: HERE"), (6, "here text same"), (7, "word " * 40_000), (8, "word " * 40_000), (9, "alone")]
    nd = NearDuplicates(frame(spark, rows), 0.65, 1)
    assert {(r["a"], r["b"]) for r in nd.pairs().collect()} == {(4, 5), (4, 6), (5, 6), (7, 8)}
    groups = {r["id"]: (r["group_id"], r["links"]) for r in nd.groups().collect()}
    assert groups == {4: (4, 0), 5: (4, 0), 6: (4, 0), 7: (7, 0), 8: (7, 0), 9: (9, 0)}
    empty = NearDuplicates(frame(spark, rows).limit(0), 0.65, 1)
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_overfull_buckets_lose_nothing(spark, monkeypatch):
    import cairn.llm.near as near

    rows = [(i, " ".join(WORDS[:30] + [f"x{i}"])) for i in range(40)] + [(100 + i, " ".join(WORDS[40 + i : 60 + i])) for i in range(300)]
    nd = NearDuplicates(frame(spark, rows), 0.65, 1)
    sigs = nd.base.select("sig").distinct()
    names, counts, _ = near.vocabulary(nd.base, 1e-3)
    ids = {r["sig"]: r["id"] for r in nd.base.select("sig", "id").collect()}
    got = {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in nd._by_prefix(sigs, names, counts).collect()}
    assert got >= brute(rows, 0.65) and len(got) < 340 * 339 / 2 / 3
    monkeypatch.setattr(near, "BUCKET", 3)
    assert {(r["a"], r["b"]) for r in nd.pairs().collect()} <= brute(rows, 0.65)


def test_chains_are_one_group(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i, 1000 - i) for i in [*range(1, 41), 100, 101, 200]], "sig bigint, first bigint")
    got = {r["sig"]: r["group_id"] for r in components(links, nodes).collect()}
    assert {got[i] for i in range(1, 41)} == {960} and got[100] == got[101] == 899 and got[200] == 800


def test_draws_agree_as_often_as_weights_do():
    g = np.random.default_rng(0)
    h, w = g.integers(1, 2**63, 60).astype(np.uint64), g.random(60) + 0.1
    d = sample(h, w, np.r_[np.arange(40), np.arange(20, 60)], np.array([0, 40, 80]), 2000, 3)
    true = w[20:40].sum() / w.sum()
    assert abs((d[0] == d[1]).mean() - true) < 0.05


def test_long_texts_draw_in_blocks(monkeypatch):
    import cairn.llm.near as near

    g = np.random.default_rng(0)
    h, w = g.integers(1, 2**63, 500).astype(np.uint64), g.random(500) + 0.1
    whole = sample(h, w, np.arange(500), np.array([0, 500]), 64, 3)
    monkeypatch.setattr(near, "_BLOCK", 70)
    assert (sample(h, w, np.arange(500), np.array([0, 500]), 64, 3) == whole).all()


def test_buckets_across_batches():
    import pyarrow as pa

    rows = [(1, 5), (1, 5), (1, 6), (2, 7), (3, 1), (3, 2), (3, 3), (3, 4), (3, 9)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], ["key", "sig"]) for part in (rows[:2], rows[2:6], rows[6:])]
    out = [tuple(r.values()) for b in _bucket_pairs(3)(iter(batches)) for r in b.to_pylist()]
    assert Counter(out) == Counter([(None, 5, 6), (3, 1, None), (3, 2, None), (3, 3, None), (3, 4, None), (3, 9, None)])


@pytest.mark.parametrize("text, size, wanted", [("A b a", 1, ["a", "a\x012", "b"]), ("a b c", 2, ["a\x02b", "b\x02c"]), ("a", 5, ["a"]), ("?!", 1, [])])
def test_tokens(text, size, wanted):
    assert tokens(text, size) == wanted


def test_buckets_keep_possible_pairs_only():
    import pyarrow as pa

    from cairn.llm.words import marks

    docs = [" ".join(sorted(f"w{k}" for k in range(i, i + 40))) for i in (0, 2, 30, 32, 200)]
    rows = [np.array([9, 9, 9, 9, 9, 10]), np.array([1, 2, 3, 4, 5, 5]), np.full(6, 40, np.int32), *(np.append(m, m[-1]) for m in marks(docs, [40] * 5))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 2]) for c in rows], [str(c) for c in range(7)]) for k in (0, 2, 4)]
    out = [tuple(r.values()) for b in _bucket_pairs(9, 0.65)(iter(batches)) for r in b.to_pylist()]
    assert out == [(None, 1, 2), (None, 3, 4)]


def test_turns_find_what_one_turn_finds(spark, monkeypatch):
    import cairn.llm.near as near

    rows = [(i, " ".join([*WORDS[i // 3 : i // 3 + 30], f"x{i}"])) for i in range(60)]
    found = lambda: {(r["a"], r["b"]) for r in NearDuplicates(frame(spark, rows), 0.65, 1).candidates().collect()}
    many = found()
    monkeypatch.setattr(near, "TURNS", 1)
    assert many and many == found()


def test_a_turn_works_by_batch_and_by_slot(monkeypatch):
    import pyarrow as pa

    import cairn.llm.near as near

    calls, mix = [], near.mix
    monkeypatch.setattr(near, "mix", lambda x: calls.append(1) or mix(x))
    docs = [" ".join(sorted(f"w{k}" for k in range(i % 50, i % 50 + 20))) for i in range(600)]
    columns = [pa.array(range(600)), pa.array(docs), pa.array([20] * 600, pa.int32()), *(pa.array(range(m, 600 + m)) for m in range(4))]
    batch = pa.RecordBatch.from_arrays(columns, ["sig", "doc", "n", *near.MARKS])
    out = [r for b in near._bands(pa.array([], pa.string()), np.empty(0), 1.0, 40, 7, 11, (8, 16), 6)(iter([batch])) for r in b.to_pylist()]
    # Neither a hash for each text nor a row for each text and band.
    assert len(calls) < 20 and [r["slot"] for r in out] == list(range(6))
    rows = np.concatenate([np.frombuffer(r["cells"], np.int64).reshape(7, -1) for r in out], axis=1)
    assert rows.shape[1] == 600 * 8 and sorted(set(rows[1])) == list(range(600))
    assert (rows[2] == 20).all() and all((rows[3 + m] == rows[1] + m).all() for m in range(4))
    # Texts of the same tokens have the same eight keys, others hardly any in common.
    assert len({(k, s % 50) for k, s in zip(rows[0], rows[1])}) == 50 * 8


def test_slots_lose_no_pair():
    import pyarrow as pa

    from cairn.llm.near import _in_slots, _out_of_slots

    g = np.random.default_rng(5)
    lots = [np.stack([g.integers(-30, 30, 40) * 0x9E3779B97F4A7C1, g.integers(0, 25, 40), *np.zeros((5, 40), np.int64)]) for _ in range(4)]
    met = {}
    for key, sig in np.concatenate(lots, axis=1)[:2].T.tolist():
        met.setdefault(key, set()).add(sig)
    wanted = Counter((None, *p) for sigs in met.values() for p in combinations(sorted(sigs), 2))
    rows = pa.concat_batches([_in_slots([x, y], 5) for x, y in (lots[:2], lots[2:])])
    rows = rows.take(pa.array(np.argsort(np.asarray(rows.column(0)), kind="stable")))
    for size in (1, 3, 100):
        batches = (rows.slice(k, size) for k in range(0, rows.num_rows, size))
        assert Counter(tuple(r.values()) for b in _bucket_pairs(100)(_out_of_slots(batches)) for r in b.to_pylist()) == wanted
    assert not any(b.num_rows for b in _out_of_slots(iter([_in_slots([np.array([[1, 2]] + [[0, 0]] * 6)], 1)])))


def test_a_draw_tells_shingle_and_step():
    """Numbers of draws are alike only where the same shingle is drawn at the same step, whatever the other texts of the batch are."""
    g = np.random.default_rng(2)
    h, w = g.integers(1, 2**63, 300).astype(np.uint64), g.random(300) * 5 + 0.01
    alone = [sample(h[i : i + 30], w[i : i + 30], np.arange(30), np.array([0, 30]), 280, 11, (56, 112))[0] for i in range(0, 270, 30)]
    together = sample(h, w, np.arange(270), np.arange(0, 271, 30), 280, 11, (56, 112))
    assert (np.array(alone) == together).all() and len(np.unique(together)) == together.size
