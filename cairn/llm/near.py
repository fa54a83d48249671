"""Near-duplicate records with small edits (problem 7).

Improved consistent weighted sampling draws, for each of bands x rows hash functions, one shingle of a text with a
probability in proportion to its TF-IDF weight, so that two texts draw the same one as often as their weighted Jaccard
similarity says. Texts that agree in all rows of a band become candidates; each candidate pair is verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from cairn.llm.bits import bit_set, held
from cairn.llm.words import MARKS, token_rows
from cairn.session import Scratch, release, shuffle_width, stage

BANDS, ROWS = 40, 7
#: The bands are drawn, shuffled and searched in so many turns, one after the other, so that only one turn's rows are on disk at a time.
TURNS = 5
#: Shingles in fewer than this share of the texts all weigh as if in that share: the dictionary of the others
#: has at most mean-shingles-per-text / share entries, whatever the number of texts.
RARE_SHARE = 1e-3
#: A band key shared by more distinct texts than this is not compared pair by pair within its task but searched by prefixes.
BUCKET = 4_000
#: A token or key of more texts than this is split into groups of about so many, each pair of groups being a tile.
HOT = 2_000
#: Band rows are shuffled in slots of about so many, and a task puts so many of its own into slots at once: a slot's part of them is one row to Spark.
SLOT, LOT = 1 << 17, 1 << 18
_TABLE, _BLOCK = 4096, 1 << 15
_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _draws(k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r ~ Gamma(2,1), ln c with c ~ Gamma(2,1), b ~ U(0,1), each for _TABLE slots and k functions; a shingle's hash picks its three slots."""
    g = np.random.default_rng(seed)
    r = g.gamma(2.0, 1.0, (_TABLE, k)).astype(np.float32)
    lnc = np.log(g.gamma(2.0, 1.0, (_TABLE, k))).astype(np.float32)
    return np.maximum(r, 1e-6), lnc, g.random((_TABLE, k)).astype(np.float32)


@lru_cache(maxsize=2)
def _draws_of(k: int, seed: int, part: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.ascontiguousarray(x[:, slice(*part)]) for x in _draws(k, seed))


def _values(hashes: np.ndarray, weights: np.ndarray, k: int, seed: int, part: tuple[int, int]) -> np.ndarray:
    """A number for each shingle (rows) under each of a part of the k functions (columns): its upper half goes up with ln a, its lower half is a hash of shingle and t.

    The shingle that a text draws is thus the one of the least number, and the number itself tells what was drawn.
    """
    r_, lnc_, b_ = _draws_of(k, seed, part)
    m = np.uint64(_TABLE - 1)
    r, lnc, b = r_[(hashes & m).astype(np.int64)], lnc_[((hashes >> np.uint64(20)) & m).astype(np.int64)], b_[((hashes >> np.uint64(40)) & m).astype(np.int64)]
    t = np.floor(np.log(weights).astype(np.float32)[:, None] / r + b)
    a = (lnc - r * (t - b) - r).view(np.int32)
    key = mix(hashes[:, None] + t.astype(np.int64).view(np.uint64) * _M) >> np.uint64(32)
    # Numbers below zero have all bits but the sign turned over, so that integers are in the order of the floats.
    return ((a ^ ((a >> 31) & 0x7FFFFFFF)).astype(np.int64) << 32) | key.view(np.int64)


def sample(hashes: np.ndarray, weights: np.ndarray, codes: np.ndarray, offsets: np.ndarray, k: int, seed: int, part: tuple[int, int] | None = None) -> np.ndarray:
    """Draws of texts: text i has the distinct tokens codes[offsets[i]:offsets[i+1]], at least one, into hashes and weights (> 0).

    Gives a matrix of texts x k of 64-bit keys of (token, t); part: from which to which of the k functions only.
    """
    part = part or (0, k)
    out, at = np.full((len(offsets) - 1, part[1] - part[0]), np.iinfo(np.int64).max), offsets.tolist()
    if len(hashes) <= 2 * _BLOCK:
        values = _values(hashes, weights, k, seed, part)
        for i, row in enumerate(out):
            np.minimum.reduce(values.take(codes[at[i] : at[i + 1]], axis=0), axis=0, out=row)
        return out.view(np.uint64)
    for i, row in enumerate(out):
        for s in range(at[i], at[i + 1], _BLOCK):
            own = codes[s : min(s + _BLOCK, at[i + 1])]
            np.minimum(row, _values(hashes[own], weights[own], k, seed, part).min(axis=0), out=row)
    return out.view(np.uint64)


def band_keys(draws: np.ndarray, bands: int, rows: int, first: int = 0) -> np.ndarray:
    """One key per text and band, the bands being numbered from `first`."""
    d = draws.reshape(len(draws), bands, rows)
    h = np.broadcast_to(np.arange(first, first + bands, dtype=np.uint64) * _M, d.shape[:2])
    for i in range(rows):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + d[:, :, i])
    return h.view(np.int64)


def _coded(docs: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The tokens of all docs as codes, and how many each doc has."""
    lists = pc.split_pattern(docs, " ")
    return lists.flatten().dictionary_encode(), np.asarray(pc.list_value_length(lists))


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of the batch each token is (tokens of a text are distinct)."""
    for batch in batches:
        coded, _ = _coded(batch.column(0))
        n = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n)], ["s", "n"])


def _in_slots(parts: list[np.ndarray], slots: int) -> pa.RecordBatch:
    """Columns of rows, the first of them the key, as rows (slot, cells): one for each slot, with the cells of all its rows. All rows of a key are in one slot."""
    rows = np.concatenate(parts, axis=1)
    slot = (rows[0].view(np.uint64) % np.uint64(slots)).astype(np.int32)
    order = np.argsort(slot)
    rows, slot = rows[:, order], slot[order]
    starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    cells = [rows[:, s:e].tobytes() for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(slot)])]
    return pa.RecordBatch.from_arrays([pa.array(slot[starts]), pa.array(cells, pa.binary())], ["slot", "cells"])


def _out_of_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, cells) sorted by slot to the rows in them (key, sig, n, marks) sorted by key and sig, without those whose key no other row of the slot has."""

    def opened(cells: list[bytes]) -> pa.RecordBatch:
        rows = np.concatenate([np.frombuffer(c, np.int64).reshape(3 + len(MARKS), -1) for c in cells], axis=1)
        order = np.argsort(rows[0])
        same = np.diff(rows[0][order]) == 0
        rows = rows[:, order[np.append(same, False) | np.append(False, same)]]
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["key", "sig", "n", *MARKS])

    last, waiting = None, []
    for batch in batches:
        for slot, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if slot != last and waiting:
                yield opened(waiting)
                waiting = []
            last = slot
            waiting.append(cells)
    if waiting:
        yield opened(waiting)


def _bands(vocabulary: pa.Array, idf: np.ndarray, rare: float, bands: int, rows: int, seed: int, turn: tuple[int, int], slots: int):
    """Rows (sig, doc, n, marks) to rows (key, sig, n, marks), one for each band of a turn, which come together in their slots (see _in_slots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                # Copies within the batch are looked at once: the pre-aggregation of large groups of copies.
                sigs, first = np.unique(np.asarray(batch.column(0)), return_index=True)
                coded, lengths = _coded(batch.column(1).take(pa.array(first)))
                hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object)).astype(np.uint64)
                at = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=vocabulary), -1)).astype(np.int64)
                weight = np.where(at >= 0, idf[at], rare) if len(idf) else np.full(len(hashes), rare)
                draws = sample(hashes, weight, np.asarray(coded.indices).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)]), bands * rows, seed, (turn[0] * rows, turn[1] * rows))
                own = turn[1] - turn[0]
                rest = [np.asarray(batch.column(c))[first].astype(np.int64) for c in range(2, batch.num_columns)]
                parts.append(np.stack([band_keys(draws, own, rows, turn[0]).ravel(), *(np.repeat(c, own) for c in (sigs, *rest))]))
                held += parts[-1].shape[1]
                if held >= LOT:
                    yield _in_slots(parts, slots)
                    parts, held = [], 0
        if held:
            yield _in_slots(parts, slots)

    return run


def _fit(rows: list[np.ndarray], x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether numbers alone, (n, *marks) of rows, leave it possible that the texts at x and at y are similar. No similar pair is lost."""
    n = rows[0]
    both = n[x] + n[y]
    differ = sum(np.bitwise_count(m[x] ^ m[y]).astype(np.int64) for m in rows[1:])
    # similarity = common / (both - common), and common is at most (both - differ) / 2.
    return (np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * least - 1e-9) & ((both - differ) / 2 >= both * (least / (1 + least)) - 1e-9)


def _bucket_pairs(limit: int, least: float = 0.0):
    """Of rows (key, sig) or (key, sig, n, marks) sorted by key and sig: pairs (null, a, b) of each key's distinct sigs, those that n and marks leave possible, or (key, a, null) rows of keys with more than `limit`."""

    def found(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        keys, sigs, *rest = (c[new] for c in rows)
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        full = np.repeat(sizes > limit, sizes)
        if full.any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[full]), pa.array(sigs[full]), pa.nulls(int(full.sum()), pa.int64())], ["key", "a", "b"])
        ends = np.repeat(starts + sizes, sizes)
        at, step, x, y, held = np.flatnonzero(~full & (np.repeat(sizes, sizes) > 1)), 1, [], [], 0
        while len(at):
            # Each text with the one that stands `step` after it under the same key.
            at = at[at + step < ends[at]]
            good = at[_fit(rest, at, at + step, least)] if rest and len(at) else at
            x.append(good), y.append(good + step)
            held, step = held + len(good), step + 1
            if x and (held >= 50_000 or not len(at)):
                a, b = sigs[np.concatenate(x)], sigs[np.concatenate(y)]
                if held:
                    yield pa.RecordBatch.from_arrays([pa.nulls(held, pa.int64()), pa.array(a), pa.array(b)], ["key", "a", "b"])
                x, y, held = [], [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(c) for c in batch.columns]
            now[2:3] = [c.astype(np.int64) for c in now[2:3]]
            parts.append(now)
            if now[0][-1] == parts[0][0][0]:
                continue
            # The last key may go on in the next batch.
            rows = [np.concatenate(c) for c in zip(*parts)]
            last = int(np.flatnonzero(rows[0][1:] != rows[0][:-1])[-1]) + 1
            yield from found([c[:last] for c in rows])
            parts = [[c[last:] for c in rows]]
        if parts:
            yield from found([np.concatenate(c) for c in zip(*parts)])

    return run


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, frozenset()
        for batch in batches:
            sims = np.zeros(batch.num_rows)
            for i, (b, dx, dy) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                if b != last:
                    last, y = b, frozenset(dy.split(" "))
                x = dx.split(" ")
                common = len(y.intersection(x))
                sims[i] = common / (len(x) + len(y) - common)
            good = pa.array(sims >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(sims[sims >= least])], ["a", "b", "similarity"])

    return run


def _wanted(bits: np.ndarray):
    """The rows whose first column may be in a set of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held(bits, np.asarray(batch.column(0)))))

    return run


def tiles(rows: DataFrame, key: str, hot: int) -> DataFrame:
    """rows (key, sig, ...) with columns own, i, j: those of a key of more than `hot` rows are in groups by sig (own), each group in a tile (i, j) with itself and with
    every other one; the rows of other keys are in the one tile (0, 0). Every two rows of a key meet in one tile: i is the own group of one of them, j of the other."""
    over = rows.groupBy(key).count().where(F.col("count") > hot).select(key, F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    rows = rows.join(over, key, "left").withColumn("own", F.pmod("sig", F.coalesce("parts", F.lit(1))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return rows.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).drop("other", "parts")


def vocabulary(rows: DataFrame, share: float) -> tuple[list[str], list[int], int]:
    """Tokens in at least `share` of the texts, in how many, and the number of texts. Counted over all texts."""
    total = rows.count()
    counts = rows.select("doc").mapInArrow(_token_counts, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    found = sorted((r["s"], r["n"]) for r in counts.where(F.col("n") >= max(2, total * share)).collect())
    return [r[0] for r in found], [r[1] for r in found], total


class NearDuplicates:
    """Similar texts of a table: classes of copies, and links between classes.

    texts: columns `id` (unique) and `text`. Null texts and texts without a word belong to no class. A copy has the same
    shingles, each as often; its class is `sig`. `links()` gives pairs of classes (a < b) with their similarity, at least
    `similarity`: weighted Jaccard over shingles counted with repetition. `pairs()` expands both to pairs of ids,
    `groups()` gives each id the smallest id of the texts it is linked with, directly or over others.
    Copies are never compared or expanded among themselves before pairs().
    """

    def __init__(self, texts: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = BANDS, rows: int = ROWS, rare_share: float = RARE_SHARE, seed: int = 11, id_col: str = "id", text_col: str = "text"):
        self.least, self.bands, self.rows, self.share, self.seed = similarity, bands, rows, rare_share, seed
        # The texts are cut into tokens once; all further passes read that table.
        self.base = stage(token_rows(texts, id_col, text_col, shingle), "tokens")

    def members(self) -> DataFrame:
        return self.base.select("sig", "id")

    def candidates(self) -> DataFrame:
        """Pairs of classes (a < b) that share a band and that lengths and marks leave possible, those of overfull buckets found by prefixes instead; without repeats."""
        names, counts, total = vocabulary(self.base, self.share)
        least = max(1.0, total * self.share)  # texts that the rarest shingles count as being in
        idf = np.log(1 + total / np.maximum(np.array(counts, float), least)) if names else np.empty(0)
        rare = math.log(1 + total / least)
        turns = [(k * self.bands // TURNS, (k + 1) * self.bands // TURNS) for k in range(TURNS)]
        width = shuffle_width(self.base.sparkSession)
        slots = lambda t: width * max(1, math.ceil(total * (t[1] - t[0]) / (width * SLOT)))
        found = [self._turn(_bands(pa.array(names, pa.string()), idf, rare, self.bands, self.rows, self.seed, t, slots(t))) for t in turns if t[0] < t[1]]
        found = reduce(DataFrame.unionByName, found)
        pairs = found.where(F.col("b").isNotNull()).select("a", "b")
        over = found.where(F.col("b").isNull())
        if not over.isEmpty():
            pairs = pairs.unionByName(self.possible(self._by_prefix(over.select(F.col("a").alias("sig")).distinct(), names, counts)))
        return pairs.distinct()

    def _turn(self, bands) -> DataFrame:
        """The pairs and overfull keys of one turn's bands. Their rows, the most that this operator shuffles, are gone afterwards."""
        spark = self.base.sparkSession
        width, bucket_pairs = shuffle_width(spark), _bucket_pairs(BUCKET, self.least)
        rows = self.base.select("sig", "doc", "n", *MARKS).mapInArrow(bands, "slot int, cells binary")
        rows = rows.repartitionById(width, F.col("slot") % width).sortWithinPartitions("slot")
        found = stage(rows.mapInArrow(lambda batches: bucket_pairs(_out_of_slots(batches)), "key bigint, a bigint, b bigint"), "near")
        del rows
        release(spark)
        return found

    def _by_prefix(self, sigs: DataFrame, names: list[str], counts: list[int]) -> DataFrame:
        """All pairs of `sigs` that may reach the similarity: they share one of their rarest shingles (a prefix that is long
        enough for it, so no pair is lost), and what follows it in both is long enough for the rest of the overlap that they need.
        Buckets of many look-alikes hold frequent shingles; those come last. A shingle of many texts is split into tiles."""
        spark = self.base.sparkSession
        known = spark.createDataFrame(list(zip(names, counts)), "s string, f long")
        docs = self.base.join(sigs, "sig", "left_semi").dropDuplicates(["sig"]).select("sig", "n", F.split("doc", " ").alias("w"))
        docs = docs.select("sig", "n", F.explode("w").alias("s")).join(F.broadcast(known), "s", "left")
        docs = docs.withColumn("rank", F.row_number().over(Window.partitionBy("sig").orderBy(F.coalesce("f", F.lit(1)), "s")))
        need = F.ceil(F.col("n") * F.lit(self.least) - 1e-9)
        prefix = tiles(docs.where(F.col("rank") <= F.col("n") - need + 1).select("sig", "n", "rank", F.xxhash64("s").alias("t")), "t", HOT)
        side = lambda k: [F.col(c).alias(f"{c}{k}") for c in ("sig", "n", "rank", "own")]
        both = prefix.select("t", "i", "j", *side(1)).join(prefix.select("t", "i", "j", *side(2)), ["t", "i", "j"])
        once = (F.col("own1") == F.col("i")) & (F.col("own2") == F.col("j")) & ((F.col("i") < F.col("j")) | (F.col("sig1") < F.col("sig2")))
        fits = F.least("n1", "n2") >= F.greatest("n1", "n2") * F.lit(self.least) - 1e-9
        rest = F.least(F.col("n1") - F.col("rank1"), F.col("n2") - F.col("rank2")) + 1
        enough = rest >= (F.col("n1") + F.col("n2")) * F.lit(self.least / (1 + self.least)) - 1e-9
        return both.where(once & fits & enough).select(F.least("sig1", "sig2").alias("a"), F.greatest("sig1", "sig2").alias("b")).distinct()

    def links(self) -> DataFrame:
        """a, b, similarity of classes, verified on their whole texts."""
        found = stage(self.candidates(), "pairs")
        bits = bit_set(found.select(F.explode(F.array("a", "b")).alias("sig")))
        # Most texts are in no pair: they are left out before the texts are shuffled.
        docs = self.base.select("sig", "doc").mapInArrow(_wanted(bits), "sig bigint, doc string").dropDuplicates(["sig"])
        x, y = docs.select(F.col("sig").alias("a"), F.col("doc").alias("x")), docs.select(F.col("sig").alias("b"), F.col("doc").alias("y"))
        both = found.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        return both.mapInArrow(_verified(self.least), "a bigint, b bigint, similarity double")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that numbers alone do not rule out: lengths that fit, and marks that leave enough tokens in common. No similar pair is lost."""
        one = self.base.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n", *MARKS)])
        side = lambda k, s: one.select(F.col("sig").alias(s), *[F.col(c).alias(f"{c}{k}") for c in ("n", *MARKS)])
        met = pairs.join(side("x", "a"), "a").join(side("y", "b"), "b")
        differ = sum((F.bit_count(F.col(f"{m}x").bitwiseXOR(F.col(f"{m}y"))) for m in MARKS[1:]), F.bit_count(F.col("m0x").bitwiseXOR(F.col("m0y"))))
        both = F.col("nx") + F.col("ny")
        # similarity = common / (both - common), and common is at most (both - differ) / 2.
        enough = (both - differ) / 2 >= both * F.lit(self.least / (1 + self.least)) - 1e-9
        return met.where((F.least("nx", "ny") >= F.greatest("nx", "ny") * F.lit(self.least) - 1e-9) & enough).select("a", "b")

    def pairs(self) -> DataFrame:
        """a, b, similarity for ids a < b: every pair of copies and of texts of linked classes.

        The result itself has n^2 / 2 rows for n copies of a text; adaptive execution splits such a class on both sides. groups() has no such rows.
        """
        links = stage(self.links(), "links")
        m = self.members()
        across = links.join(m.select(F.col("sig").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("sig").alias("b"), F.col("id").alias("y")), "b")
        across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
        x, y = m.select("sig", F.col("id").alias("a")), m.select("sig", F.col("id").alias("b"))
        return across.unionByName(x.join(y, "sig").where(F.col("a") < F.col("b")).select("a", "b", F.lit(1.0).alias("similarity")))

    def groups(self) -> DataFrame:
        """id, group_id, links: the smallest id of its connected group, and the number of other classes its class is linked with."""
        links = stage(self.links().select("a", "b"), "links")
        first = self.members().groupBy("sig").agg(F.min("id").alias("first"))
        degree = links.select(F.col("a").alias("sig")).unionByName(links.select(F.col("b").alias("sig"))).groupBy("sig").agg(F.count("*").alias("links"))
        label = components(links, first)
        return self.members().join(label, "sig").join(degree, "sig", "left").select("id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """sig, group_id: the least `first` of each connected component of `links` (a, b) over `nodes` (sig, first)."""
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ids = nodes.join(edges.select(F.col("a").alias("sig")).distinct(), "sig", "left_semi").select("sig", "first")
    e = edges.join(ids.select(F.col("sig").alias("a"), F.col("first").alias("x")), "a").join(ids.select(F.col("sig").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    label = spread(stage(e, "edges"))
    return nodes.join(label.withColumnRenamed("x", "first"), "first", "left").select("sig", F.coalesce("l", "first").alias("group_id"))


def spread(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """x, l: the least node that each node of `edges` (x, y, every edge both ways) is connected with.

    Labels spread to neighbours and then jump to their own label's label, so that rounds grow with the logarithm of a
    component's diameter; each round is a written table. Nothing but one sign per round comes to the driver.
    """
    keep = scratch.stage if scratch else stage
    label = edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("l"))
    while True:
        near = edges.join(label.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        step = label.join(near, "x").select("x", F.least("l", "m").alias("n"), "l")
        jump = label.select(F.col("x").alias("n"), F.col("l").alias("j"))
        new = step.join(jump, "n", "left").select("x", F.coalesce(F.least("n", "j"), "n").alias("l"), (F.coalesce(F.least("n", "j"), "n") != F.col("l")).alias("moved"))
        seen = Observation()
        label = keep(new.observe(seen, F.max("moved").alias("moved")).select("x", "l"), "label")
        if not seen.get["moved"]:
            return label
