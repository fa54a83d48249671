"""Duplicates of new batches against all history, without reprocessing it (problem 5).

An inverted index holds postings of accepted statements: each under its rarest tokens, as many as it needs to share one
with any text similar enough. A batch probes the index with its own prefixes: only the files that hold its tokens are
read, lengths are filtered in the join, the overlap is verified, and postings of new statements are appended.

The index is a folder: runs of postings and of word statistics, partitioned by token, the order of tokens, a letter model of
names, and a manifest that names them. It can be closed and opened again at any time; a batch counts once its manifest stands.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairn.llm.near import _coded, mix, spread, tiles
from cairn.session import Scratch, file_system, release, shuffle_width, stage, stage_path

#: Tokens hash to so many slots, by which runs are partitioned; a run of few rows has fewer buckets, of about PER_BUCKET rows.
SLOTS, PER_BUCKET = 1 << 16, 200_000
#: Runs of about the same size (within this factor) that are merged once there are so many.
FAN = 4
#: A key of more texts than this is split into groups of about so many, each pair of groups being a tile.
HOT = 2_000
#: The rows of a key of up to so many are paired, and each pair is compared once; those of more are compared in tiles.
PAIRED = 200
#: Words in fewer than this share of the texts have no place of their own in the order of tokens: it has at most mean-words-per-text / share entries.
RARE_SHARE = 1e-3
#: Written into the manifest: an index of another form is not read.
FORM = 2
#: Log odds of a word's letters from which it counts as a name; and the slots that letter groups hash to.
SURE, DIMENSIONS = 4.0, 1 << 14
#: Words seen as names by their script that the letter model needs; with fewer, capitals within sentences tell.
LEAST_NAMES = 20

_WORD = re.compile(r"([^\W_]+)")
_CYRILLIC, _LATIN = re.compile(r"[Ѐ-ӿ]"), re.compile(r"^[^\W\d_Ѐ-ӿ]{4,}$")
TEXT = "fact_id bigint, words string, inside string, mixed boolean"
WORDS = "word string, n bigint, mixed bigint, small bigint, big bigint"
POSTING = "block bigint, n int, sig bigint"
STATEMENT = "sig bigint, fact_id bigint, first_id bigint, n int, words string"


def grams(word: str) -> list[int]:
    """Hashed beginnings, ends and trigrams of a word."""
    parts = {f"^{word[:2]}", f"^{word[:3]}", f"^{word[:4]}", f"{word[-2:]}$", f"{word[-3:]}$", f"{word[-4:]}$", *(word[i : i + 3] for i in range(len(word) - 2))}
    return [zlib.crc32(g.encode()) % DIMENSIONS for g in sorted(parts)]


def letter_weights(counts: list[tuple[int, int, int]], names: int, plain: int) -> np.ndarray:
    """Naive Bayes: the log odds of each slot of letter groups, from (slot, names with it, plain words with it) rows."""
    w = np.full(DIMENSIONS, math.log(0.5 / (names + 2)) - math.log(0.5 / (plain + 2)), np.float32)
    for slot, a, b in counts:
        w[slot] = math.log((a + 0.5) / (names + 2)) - math.log((b + 0.5) / (plain + 2))
    return w


def is_name(word: str, mixed: int, small: int, big: int, weights: np.ndarray | None) -> bool:
    """Whether a word is an invented name, by where all accepted texts have it, else by its letters.

    mixed: Cyrillic texts that have it; small, big: texts that have it within a sentence in small letters, with a capital.
    Words that are mostly small are none, other Latin words in Cyrillic texts are; of the rest the letters decide.
    """
    if not _LATIN.match(word) or small > big:
        return False
    if mixed > small:
        return True
    return weights is not None and float(weights[grams(word)].sum()) > SURE


def close(a: str, b: str, most: int = 2) -> bool:
    """Whether `most` insertions, deletions, substitutions or swaps of neighbours turn a into b."""
    if abs(len(a) - len(b)) > most:
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1] <= most


def differing(a: Counter, b: Counter, least: float) -> tuple[list[str], list[str]] | None:
    """The words on one side only, of each side, of two word counts that are similar enough and have the same numbers."""
    na, nb = a.total(), b.total()
    if min(na, nb) < least * max(na, nb) - 1e-9:
        return None
    common = (a & b).total()
    if common < least * (na + nb - common) - 1e-9:
        return None
    left, right = [w for w in a if w not in b], [w for w in b if w not in a]
    if any(w.isdigit() for w in left) or any(w.isdigit() for w in right):
        return None
    return left, right


def same_names(left: list[str], right: list[str], names: frozenset[str]) -> bool:
    """Whether the words on one side only hold no other name: a name there is one, unless the other side has a plain word of nearly the same letters."""
    for mine, other in ((left, right), (right, left)):
        for w in mine:
            if w in names and not any(o not in names and close(w, o) for o in other):
                return False
    return True


def repeats(a: Counter, b: Counter, names: frozenset[str], least: float) -> bool:
    """Whether two word counts say the same: similar enough, with the same numbers and the same names. names: the names of both."""
    found = differing(a, b, least)
    return found is not None and same_names(*found, names)


def is_number(word: str) -> bool:
    return word[0].isnumeric() and all(unicodedata.category(c)[0] == "N" for c in word)


class _Seen(dict):
    """Of a word: lower-cased, whether it begins with a capital, whether it is Cyrillic. Kept for the words met last."""

    def __missing__(self, word: str) -> tuple[str, bool, bool]:
        if len(self) >= 1 << 16:
            self.clear()
        low = word.lower()
        self[word] = x = low, word[0].isupper(), bool(_CYRILLIC.search(low))
        return x


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text, lower-cased and sorted, and how each stands in it: 1 in small letters, 2 with a capital, 0 at a sentence's start or in a text of one case."""
    seen = _Seen()
    for batch in batches:
        ids, words, inside, mixed = [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts = _WORD.split(text)
            own = [seen[w] for w in parts[1::2]]
            if not own:
                continue
            if text.lower() != text and text.upper() != text:
                how = [0 if sep != " " and any(c in ".!?:\n" for c in sep) else 2 if w[1] else 1 for sep, w in zip(parts[::2], own)]
                how[0] = 0
            else:
                how = [0] * len(own)
            rows = sorted(zip([w[0] for w in own], how))
            ids.append(i), words.append(" ".join([w for w, _ in rows])), inside.append("".join(["012"[k] for _, k in rows]))
            mixed.append(sum([w[2] for w in own]) * 2 > len(own))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string()), pa.array(inside, pa.string()), pa.array(mixed, pa.bool_())], ["fact_id", "words", "inside", "mixed"])


def with_words(batch: DataFrame) -> DataFrame:
    """TEXT rows of the facts with a word at least; sig is the same for facts of the same words."""
    facts = batch.where(F.col("content").isNotNull() & F.col("fact_id").isNotNull()).select(F.col("fact_id").cast("bigint").alias("fact_id"), "content")
    return facts.mapInArrow(_texts, TEXT).withColumn("sig", F.xxhash64("words"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WORDS of a batch of rows (words, inside, mixed), without numbers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded, lengths = _coded(batch.column(0))
        size, mixed = len(coded.dictionary), np.array(batch.column(2).to_pylist(), bool)
        text, how = np.repeat(np.arange(len(lengths)), lengths), np.frombuffer("".join(batch.column(1).to_pylist()).encode(), np.uint8).astype(np.int64) - 48
        # A word that stands in a text in several ways counts for each; n may count it more than once, which only orders words.
        each = np.unique((text * size + np.asarray(coded.indices)) * 3 + how)
        code, k, of = each // 3 % size, each % 3, each // 3 // size
        counts = [np.bincount(code[at], minlength=size).astype(np.int64) for at in (slice(None), mixed[of], k == 1, k == 2)]
        plain = pa.array([not is_number(w) for w in coded.dictionary.to_pylist()])
        yield pa.RecordBatch.from_arrays([coded.dictionary.filter(plain), *(pa.array(c).filter(plain) for c in counts)], ["word", "n", "mixed", "small", "big"])


def word_counts(texts: DataFrame) -> DataFrame:
    """WORDS of texts: in how many texts each word is, how many of them are Cyrillic, and how it stands within their sentences. Numbers are left out: they are no names and come last in the order."""
    return summed(texts.select("words", "inside", "mixed").mapInArrow(_counted, WORDS))


def summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "mixed", "small", "big")])


def _letters(by_case: bool):
    """Rows (slot, names, plain) of a batch of WORDS, and one with slot -1 for the numbers of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = Counter(), Counter()
            for word, n, mixed, small, big in zip(*(c.to_pylist() for c in batch.columns)):
                if not _LATIN.match(word):
                    continue
                if (big > 1 and not small) if by_case else mixed > small:
                    a.update([*grams(word), -1])
                elif n > 2 and small > big and not mixed:
                    b.update([*grams(word), -1])
            slots = sorted(a.keys() | b.keys())
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array([a[s] for s in slots], pa.int64()), pa.array([b[s] for s in slots], pa.int64())], ["slot", "names", "plain"])

    return run


def _judged(weights: np.ndarray | None):
    """The names among a batch of WORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [is_name(w, m, s, b, weights) for w, m, s, b in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(rows, pa.bool_()))], ["word"])

    return run


def _prefixes(order: pa.Array, ranks: np.ndarray, least: float):
    """Rows (..., words) with n and keys: a hash of each of the text's rarest words, numbers being last, with its set of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded, n = _coded(batch.column(batch.schema.get_field_index("words")))
            n, code, size = n.astype(np.int64), np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
            hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object)).astype(np.uint64)
            number = np.array([is_number(w) for w in coded.dictionary.to_pylist()], bool)
            rank = np.zeros(size, np.int64)
            if len(order):
                at = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=order), -1)).astype(np.int64)
                rank = np.where(at >= 0, ranks[at], 0)
            rank[number] = np.iinfo(np.int64).max
            text = np.repeat(np.arange(len(n)), n)
            own = np.unique(text[number[code]] * size + code[number[code]])
            sets = np.zeros(len(n), np.uint64)
            np.add.at(sets, own // size, mix(hashes[own % size]))
            code = code[np.lexsort((hashes[code], rank[code], text))]
            place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
            # Repeats of a word stand together; one key is enough for them.
            wanted = (place < (n - np.ceil(n * least - 1e-9).astype(np.int64) + 1)[text]) & ((place == 0) | (code != np.append(-1, code[:-1])))
            keys = mix(hashes[code[wanted]] ^ mix(sets[text[wanted]] + np.uint64(1))).view(np.int64)
            ends = np.cumsum(np.bincount(text[wanted], minlength=len(n)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32()), lists], [*batch.schema.names, "n", "keys"])

    return run


def _met(least: float, paired: int):
    """Of rows (block, old, sig, n) sorted by block and old: pairs (null, a, b) of texts of a block whose lengths fit, a being new;
    of blocks of more than `paired` rows the rows (block, a, null) that any new one's length fits. Blocks without two such texts give nothing."""

    def block(key: int, sig: np.ndarray, old: np.ndarray, n: np.ndarray, out: list[list]) -> None:
        new = int(len(old) - old.sum())
        if len(sig) > paired:
            lo, hi = n[:new].min(), n[:new].max()
            found = sig[~old | ((n >= lo * least - 1e-9) & (n * least <= hi + 1e-9))].tolist()
            if len(found) > 1:
                out[0].extend([key] * len(found)), out[1].extend(found), out[2].extend([None] * len(found))
            return
        ids, sizes = sig.tolist(), n.tolist()
        for i in range(new):
            for j in range(i + 1, len(ids)):
                if min(sizes[i], sizes[j]) >= least * max(sizes[i], sizes[j]) - 1e-9:
                    out[0].append(None), out[1].append(ids[i]), out[2].append(ids[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def pairs(rows: list[tuple], whole: bool) -> Iterator[pa.RecordBatch]:
            """Of all blocks of the rows but the last one, which is held unless the rows are whole."""
            nonlocal held
            k, o, s, n = (np.concatenate(c) for c in zip(*rows))
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            ends = np.append(starts[1:], len(k))
            if not whole:
                held = [tuple(c[starts[-1] :] for c in (k, o, s, n))]
                starts, ends = starts[:-1], ends[:-1]
            out: list[list] = [[], [], []]
            busy = (ends - starts > 1) & ~o[starts]  # new rows come first
            for x, y in zip(starts[busy].tolist(), ends[busy].tolist()):
                block(int(k[x]), s[x:y], o[x:y], n[x:y], out)
                if len(out[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["block", "a", "b"])
                    out = [[], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["block", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.asarray(batch.column(0))
            held.append((k, batch.column(1).to_numpy(zero_copy_only=False), np.asarray(batch.column(2)), np.asarray(batch.column(3)).astype(np.int64)))
            if k[-1] != held[0][0][0]:
                yield from pairs(held, False)
        if held:
            yield from pairs(held, True)

    return run


def _compared(least: float):
    """Rows (fact_a, words_a, fact_b, to_b, words_b) to rows (fact_id, to, left, right): the later fact of two that are similar enough, what it is linked with, and the words that only one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for a, x, b, to, y in zip(*(c.to_pylist() for c in batch.columns)):
                found = (to is None or b < a) and differing(Counter(x.split(" ")), Counter(y.split(" ")), least)
                if found:
                    for c, v in zip(out, (max(a, b), min(a, b) if to is None else to, *found)):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["fact_id", "to", "left", "right"])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (fact_id, to) of rows (fact_id, to, left, right, names) that have the same names."""
    for batch in batches:
        good = [same_names(x, y, frozenset(names or ())) for x, y, names in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))]
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in (0, 1)], ["fact_id", "to"])


def _linked(least: float):
    """Rows (block, i, j, own, fact_id, first_id, words, names) sorted by block, tile (i, j) and fact_id, first_id being null for new texts, to rows (fact_id, to) of new texts.

    A new text is compared with every earlier text of its tile (in a tile of two groups, of the other group), statements and variants, until it is linked with one of each statement; `to` is
    that statement's id. Texts without links give no rows. Only a tile's texts are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, groups = None, []
        for batch in batches:
            out: list[list] = [[], []]
            for key, i, j, mine, fact, first, text, named in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != block:
                    block, groups = (key, i, j), []
                words, names = Counter(text.split(" ")), frozenset(named.split(" "))
                if first is not None:
                    own = next((g for g in groups if g[0] == first), None)
                    if own is None:
                        groups.append(own := (first, []))
                    own[1].append((words, names, mine))
                    continue
                hit = [g for g in groups if any((i == j or m != mine) and repeats(w, words, k | names, least) for w, k, m in g[1])]
                for g in hit:
                    out[0].append(fact), out[1].append(g[0])
                if hit:
                    groups = [g for g in groups if g not in hit]
                groups.append((min([fact, *(g[0] for g in hit)]), [(words, names, mine), *(m for g in hit for m in g[1])]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["fact_id", "to"])

    return run


class Runs:
    """Tables of a folder that grow by runs, partitioned by the slot of a key, so that a look-up reads the files of its keys' slots only.

    A run of few rows has few buckets, a large one up to SLOTS. Runs of about one size are merged, so a row is rewritten as often as
    the logarithm of the table's size, and the number of runs stays logarithmic too.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, order: list[str], runs: list[dict], per_bucket: int = PER_BUCKET):
        self.spark, self.path, self.key, self.schema, self.order, self.runs, self.per = spark, path, key, schema, order, runs, per_bucket
        self.files: list[str] = []

    def _slot(self):
        key = F.col(self.key) if self.schema.split(" ")[1].startswith("bigint") else F.xxhash64(self.key)
        return F.pmod(key, F.lit(SLOTS)).cast("int")

    def write(self, rows: DataFrame, name: str, most: int) -> list[dict]:
        """`rows`, of which there are `most` or fewer, as a run: what the manifest says of it, or nothing for no rows."""
        buckets = min(SLOTS, 1 << max(0, math.ceil(math.log2(max(1, most) / self.per))))
        seen = Observation()
        out = rows.observe(seen, F.count(F.lit(1)).alias("rows")).select("*", F.pmod(self._slot(), F.lit(buckets)).alias("bucket"))
        # Rebalanced by size: a bucket that a hot key fills is written by several tasks.
        out.hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.order).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")
        fs, p = file_system(self.spark, f"{self.path}/{name}")
        held = sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(p) if x.isDirectory())
        return [{"name": name, "rows": seen.get["rows"], "buckets": buckets, "held": held}] if held else []

    def read(self, slots: set[int] | None = None) -> DataFrame:
        """The rows of the given slots' buckets, or all."""
        self.files = [f"{self.path}/{r['name']}/bucket={b}" for r in self.runs for b in (r["held"] if slots is None else sorted({s % r["buckets"] for s in slots} & set(r["held"])))]
        if not self.files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.files)

    def read_for(self, rows: DataFrame) -> DataFrame:
        """The rows of the buckets that may hold the keys of `rows`."""
        if all(r["buckets"] == 1 for r in self.runs):
            return self.read()
        return self.read({r["slot"] for r in rows.select(self._slot().alias("slot")).distinct().collect()})  # SLOTS rows at most

    def merged(self, merge, name: str) -> list[dict]:
        """The runs after those of one size class, if there are FAN of them, became one; merge: what to do to their rows."""
        kind = lambda r: int(math.log(max(1, r["rows"] / 1000), FAN))
        runs = list(self.runs)
        for k in sorted({kind(r) for r in runs}):
            same = [r for r in runs if kind(r) == k]
            if len(same) >= FAN:
                part = Runs(self.spark, self.path, self.key, self.schema, self.order, same, self.per)
                runs = [r for r in runs if r not in same] + part.write(merge(part.read()), f"{name}-{k}", sum(r["rows"] for r in same))
        return runs


class StatementIndex:
    """The index of accepted statements, in a folder that may hold one already.

    Batches must come in the order of acceptance, fact ids growing. add(batch) gives (first_id, fact_id) of the batch's
    repeats: facts that repeat a fact with a smaller id, be it a statement or a variant of one. `first_id` is the smallest id
    that the links lead to, of the same or an earlier batch. Texts of other words are all indexed; copies do not make the index grow.

    A fact's prefix: its rarest tokens in one fixed order, names being tokens like others and numbers last, so many that two facts
    similar enough share one. Its key is the token with the fact's set of numbers, which must be equal. The order is made of the
    counts of all words accepted so far, learned with the first batch and again whenever the statements have doubled; then
    all postings are keyed anew, which costs each statement a constant number of times.

    Null and empty contents are no statements. Repeated rows are repeats. An empty batch changes nothing. Extra columns do not matter.
    A batch that fails half-way leaves the manifest, and so the index, as it was; it may be added again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, similarity: float = 0.65, per_bucket: int = PER_BUCKET):
        self.spark, self.least, self.per = spark, similarity, per_bucket
        self.path = (path or stage_path(spark, "statements")).rstrip("/")
        self.state = {"version": 0, "form": FORM, "similarity": similarity, "learned": 0, "postings": [], "statements": [], "words": [], "order": [], "letters": None, "merged": []}
        fs, p = file_system(spark, self.path)
        if fs.exists(p):
            kept = [s.getPath() for s in fs.listStatus(p) if re.fullmatch(r"manifest-\d+\.json", s.getPath().getName())]
            if kept:
                last = max(kept, key=lambda x: int(re.findall(r"\d+", x.getName())[0]))
                stream = fs.open(last)
                self.state = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                stream.close()
        if self.state.get("form") != FORM:
            raise ValueError("the index was written by an earlier version: its keys are not the ones that are looked up now")
        if self.state["similarity"] != similarity:
            raise ValueError(f"the index holds prefixes for a similarity of {self.state['similarity']}")
        self.weights, self.ranks = self._read_letters(), self._read_order()
        self.read_files: list[str] = []

    # What the folder holds.

    def _commit(self, state: dict) -> None:
        """A new manifest beside the old one; it holds from the moment it has its name."""
        state["version"] = self.state["version"] + 1
        fs, made = file_system(self.spark, f"{self.path}/manifest-{state['version']}.tmp")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.rename(made, file_system(self.spark, f"{self.path}/manifest-{state['version']}.json")[1])
        before, self.state = self.state, state
        fs.delete(file_system(self.spark, f"{self.path}/manifest-{before['version']}.json")[1], False)
        names = lambda s: {r["name"] for k in ("postings", "statements", "words", "order") for r in s[k]} | {*s["merged"], s["letters"]}
        for gone in names(before) - names(state) - {None}:
            fs.delete(file_system(self.spark, f"{self.path}/{gone}")[1], True)

    def postings(self, state: dict | None = None) -> Runs:
        return Runs(self.spark, self.path, "block", POSTING, ["block"], (state or self.state)["postings"], self.per)

    def statements(self, state: dict | None = None) -> Runs:
        return Runs(self.spark, self.path, "sig", STATEMENT, ["sig"], (state or self.state)["statements"], self.per)

    def words(self, state: dict | None = None) -> Runs:
        return Runs(self.spark, self.path, "word", WORDS, ["word"], (state or self.state)["words"], self.per)

    def order(self, state: dict | None = None) -> Runs:
        return Runs(self.spark, self.path, "word", "word string, rank bigint", ["word"], (state or self.state)["order"], self.per)

    def _read_letters(self) -> np.ndarray | None:
        if not self.state["letters"]:
            return None
        rows = self.spark.read.schema("slot int, weight float").parquet(f"{self.path}/{self.state['letters']}").collect()  # DIMENSIONS rows
        w = np.zeros(DIMENSIONS, np.float32)
        w[[r["slot"] for r in rows]] = [r["weight"] for r in rows]
        return w

    def _read_order(self, state: dict | None = None) -> tuple[pa.Array, np.ndarray]:
        if not (state or self.state)["order"]:
            return pa.array([], pa.string()), np.empty(0, np.int64)
        rows = sorted(tuple(r) for r in self.order(state).read().collect())  # mean words per text / RARE_SHARE rows at most
        return pa.array([r[0] for r in rows], pa.string()), np.array([r[1] for r in rows], np.int64)

    # What is learned of all accepted texts.

    def _learn(self, state: dict, texts: int, scratch: Scratch) -> None:
        """The order of words and the letter model from the counts of all accepted texts, of which there are `texts`."""
        name = f"v{self.state['version'] + 1}"
        counts = summed(self.words(state).read())
        if len(state["words"]) > 1:
            counts = scratch.stage(counts, "counts")
        state["order"] = self.order(state).write(counts.where(F.col("n") >= max(2, texts * RARE_SHARE)).select("word", F.col("n").alias("rank")), f"order-{name}", 1)
        self.ranks = self._read_order(state)
        for by_case in (False, True):
            slots = counts.mapInArrow(_letters(by_case), "slot int, names bigint, plain bigint").groupBy("slot").agg(F.sum("names").alias("names"), F.sum("plain").alias("plain"))
            found = [tuple(r) for r in slots.collect()]  # DIMENSIONS rows at most
            names, plain = next(((a, b) for s, a, b in found if s == -1), (0, 0))
            if names >= LEAST_NAMES or by_case:
                break
        state["letters"], self.weights = None, None
        if names and plain:
            self.weights = letter_weights([r for r in found if r[0] >= 0], names, plain)
            state["letters"] = f"letters-{name}"
            table = self.spark.createDataFrame(list(enumerate(self.weights.tolist())), "slot int, weight float")
            table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{state['letters']}")

    def keyed(self, texts: DataFrame) -> DataFrame:
        """texts (sig, words, ...) with n and keys: those of the text's prefix."""
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields)
        return texts.mapInArrow(_prefixes(*self.ranks, self.least), f"{kinds}, n int, keys array<bigint>")

    def names(self, words: DataFrame, state: dict) -> DataFrame:
        """Which of `words` (word) are names, by the counts of all accepted texts, this batch included."""
        counts = summed(self.words(state).read_for(words).join(words.distinct(), "word", "left_semi"))
        return counts.mapInArrow(_judged(self.weights), "word string")

    # Batches.

    def add(self, batch: DataFrame) -> DataFrame:
        scratch = Scratch(self.spark)
        try:
            return self._add(batch, scratch)
        except Exception:
            self.weights, self.ranks = self._read_letters(), self._read_order()
            raise
        finally:
            scratch.drop()
            release(self.spark)

    def _add(self, batch: DataFrame, scratch: Scratch) -> DataFrame:
        state = json.loads(json.dumps(self.state))
        name = f"v{self.state['version'] + 1}"
        texts, seen = scratch.stage(with_words(batch), "texts"), Observation()
        # Copies are one row before anything is compared: the first of them stands for all.
        one = F.min_by(F.struct("fact_id", "words", "inside", "mixed"), "fact_id").alias("one")
        distinct = scratch.stage(texts.groupBy("sig").agg(one).select("sig", "one.*").observe(seen, F.count(F.lit(1)).alias("texts")), "distinct")
        count = seen.get["texts"]
        if not count:
            return self.spark.createDataFrame([], "first_id bigint, fact_id bigint")
        seen = Observation()
        words = scratch.stage(word_counts(distinct).observe(seen, F.count(F.lit(1)).alias("words")), "words")
        state["words"] += self.words(state).write(words, f"words-{name}", seen.get["words"])
        if not state["postings"]:
            self._learn(state, count, scratch)
        # Texts whose very words are in the index: `old` is the statement they belong to; they need no probe.
        index, rows, seen = self.statements(state), distinct.select("sig", "fact_id", "words"), Observation()
        if state["statements"]:
            rows = rows.join(index.read_for(distinct).select("sig", F.col("first_id").alias("old")), "sig", "left")
        else:
            rows = rows.withColumn("old", F.lit(None).cast("bigint"))
        rows = scratch.stage(self.keyed(rows).observe(seen, F.sum(F.size("keys")).alias("keys")), "keys")
        keys = seen.get["keys"]
        found, resolved = self._probe(texts.select("fact_id", "sig"), rows, scratch, state, name)
        fresh = rows.where(F.col("old").isNull())
        new = fresh.join(resolved.select("sig", "first_id"), "sig").select(*[c.split(" ")[0] for c in STATEMENT.split(", ")])
        state["statements"] += index.write(new, f"statements-{name}", count)
        held = sum(r["rows"] for r in state["statements"])
        if state["learned"] and held >= 2 * state["learned"]:
            self._rebuild(state, name, held, sum(r["rows"] for r in state["postings"]) + keys, scratch)
        else:
            state["postings"] += self.postings(state).write(fresh.select(F.explode("keys").alias("block"), "n", "sig"), f"postings-{name}", keys)
            state["postings"] = self.postings(state).merged(lambda d: d, f"postings-{name}-merged")
            state["statements"] = self.statements(state).merged(lambda d: d, f"statements-{name}-merged")
            state["learned"] = state["learned"] or held
        state["words"] = self.words(state).merged(summed, f"words-{name}-merged")
        self._commit(state)
        return found

    def _probe(self, texts: DataFrame, rows: DataFrame, scratch: Scratch, state: dict, name: str) -> tuple[DataFrame, DataFrame]:
        """The batch's repeats, and sig, first_id of all its texts."""
        slim = rows.where(F.col("old").isNull()).select(F.explode("keys").alias("block"), F.lit(False).alias("old"), "sig", "n")
        known = rows.where(F.col("old").isNull()).select("sig", "fact_id", F.lit(None).cast("bigint").alias("first_id"), "words")
        both = slim
        if state["postings"]:
            # Only postings in the files of the batch's own keys. Texts come to the few that are left.
            index = self.postings(state)
            both = slim.unionByName(index.read_for(slim).select("block", F.lit(True).alias("old"), "sig", "n"))
            self.read_files = index.files
            known = known.unionByName(self.statements(state).read().select("sig", "fact_id", "first_id", "words"))
        ordered = both.repartition(shuffle_width(self.spark), "block").sortWithinPartitions("block", "old")
        met = scratch.stage(ordered.mapInArrow(_met(self.least, min(PAIRED, HOT)), "block bigint, a bigint, b bigint"), "met")
        pairs = met.where(F.col("block").isNull()).select("a", "b").distinct()
        b = known.select(F.col("sig").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("fact_id", "first_id", "words")])
        pairs = pairs.join(rows.select(F.col("sig").alias("a"), F.col("fact_id").alias("fact_id_a"), F.col("words").alias("words_a")), "a").join(b, "b")
        pairs = pairs.select("fact_id_a", "words_a", "fact_id_b", "first_id_b", "words_b").mapInArrow(_compared(self.least), "fact_id bigint, to bigint, left array<string>, right array<string>")
        done = self._same_names(scratch.stage(pairs, "compared"), state)
        hot = met.where(F.col("block").isNotNull())
        if not hot.isEmpty():
            done = done.unionByName(self._in_tiles(hot.select("block", F.col("a").alias("sig")), known, scratch, state))
        done = done.distinct()
        # Links found under different keys, copies, and statements that earlier batches showed to be one, come together.
        links = done.unionByName(rows.where(F.col("old").isNotNull()).select("fact_id", F.col("old").alias("to")))
        links = links.select(F.col("fact_id").alias("a"), F.col("to").alias("b"), F.lit(True).alias("new"))
        if state["merged"]:
            earlier = self.spark.read.schema("a bigint, b bigint").parquet(*[f"{self.path}/{m}" for m in state["merged"]])
            links = links.unionByName(earlier.withColumn("new", F.lit(False)))
        links = scratch.stage(links, "links")
        group = linked_ids(links.select("a", "b"), scratch)
        linked = links.where("new").select(F.col("a").alias("fact_id"), F.lit(True).alias("linked")).distinct()
        resolved = rows.select("sig", "fact_id").join(linked, "fact_id", "left").join(group, "fact_id", "left")
        resolved = scratch.stage(resolved.select("sig", F.col("fact_id").alias("stands_for"), F.coalesce("group_id", "fact_id").alias("first_id"), F.coalesce("linked", F.lit(False)).alias("linked")), "first")
        # A text copied very often makes a large partition of two numbers a row; adaptive execution splits it.
        found = stage(texts.join(resolved, "sig").where(F.col("linked") | (F.col("fact_id") != F.col("stands_for"))).select("first_id", "fact_id"), "repeats")
        known = group.where(F.col("fact_id") != F.col("group_id")).join(rows.select("fact_id"), "fact_id", "left_anti").select(F.col("fact_id").alias("a"), F.col("group_id").alias("b"))
        if not known.isEmpty():
            known.write.mode("overwrite").parquet(f"{self.path}/merged-{name}")
            state["merged"] = [f"merged-{name}"]
        return found, resolved

    def _same_names(self, pairs: DataFrame, state: dict) -> DataFrame:
        """The links (fact_id, to) of pairs (fact_id, to, left, right) without another name on either side."""
        words = pairs.select("fact_id", "to", "left", "right", F.explode(F.array_distinct(F.concat("left", "right"))).alias("word")).where(F.col("word").rlike(r"^[\p{L}\p{N}]{4,}$"))
        names = words.join(self.names(words.select("word"), state), "word").groupBy("fact_id", "to", "left", "right").agg(F.collect_set("word").alias("names"))
        return pairs.join(names, ["fact_id", "to", "left", "right"], "left").mapInArrow(_named, "fact_id bigint, to bigint")

    def _in_tiles(self, hot: DataFrame, known: DataFrame, scratch: Scratch, state: dict) -> DataFrame:
        """The links (fact_id, to) within blocks of many texts: rows (block, sig) of texts `known`."""
        texts = scratch.stage(known.join(hot.select("sig").distinct(), "sig", "left_semi"), "hot")
        words = texts.select("sig", F.explode(F.array_distinct(F.split("words", " "))).alias("word")).where(F.col("word").rlike(r"^[\p{L}\p{N}]{4,}$"))
        names = words.join(self.names(words.select("word"), state), "word").groupBy("sig").agg(F.array_join(F.collect_set("word"), " ").alias("names"))
        rows = hot.join(texts.join(names, "sig", "left").withColumn("names", F.coalesce("names", F.lit(""))), "sig")
        tile = ["block", "i", "j"]
        ordered = tiles(rows, "block", HOT).repartition(shuffle_width(self.spark), *tile).sortWithinPartitions(*tile, "fact_id").select(*tile, "own", "fact_id", "first_id", "words", "names")
        return ordered.mapInArrow(_linked(self.least), "fact_id bigint, to bigint")

    def _rebuild(self, state: dict, name: str, held: int, keys: int, scratch: Scratch) -> None:
        """The order learned anew, and all `held` statements keyed by it, as one run of each table."""
        texts = self.statements(state).read().drop("n")
        self._learn(state, held, scratch)
        rows = scratch.stage(self.keyed(texts), "rows")
        state["postings"] = self.postings(state).write(rows.select(F.explode("keys").alias("block"), "n", "sig"), f"postings-{name}-anew", keys)
        state["statements"] = self.statements(state).write(rows.select(*[c.split(" ")[0] for c in STATEMENT.split(", ")]), f"statements-{name}-anew", held)
        state["learned"] = held


def linked_ids(links: DataFrame, scratch: Scratch) -> DataFrame:
    """fact_id, group_id: the smallest id that the links (a, b) lead each id to."""
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("x"), F.col("b").alias("y"))
    return spread(edges, scratch).select(F.col("x").alias("fact_id"), F.col("l").alias("group_id"))


def taken_together(spans: list[tuple]) -> list[tuple]:
    """The first and last batch of each group of batches, of rows (batch, least fact id, largest fact id, facts); a batch may have several rows."""
    batches: dict = {}
    for b, lo, hi, n in sorted(spans):
        x = batches.get(b, (lo, hi, 0))
        batches[b] = min(x[0], lo), max(x[1], hi), x[2] + n
    groups: list[list] = []
    held = 0
    for b, (lo, hi, n) in batches.items():
        own = groups[-1] if groups else None
        if own and len(groups) > 1 and own[3] < lo and own[4] + n <= held:
            own[1], own[3], own[4] = b, hi, own[4] + n
        else:
            held += own[4] if own else 0
            groups.append([b, b, lo, hi, n])
    return [(g[0], g[1]) for g in groups]


def repeated_facts(facts: DataFrame, similarity: float = 0.65) -> DataFrame:
    """first_id, fact_id of all repeats in a table of batches (batch_id, fact_id, content); a null batch counts as the first.

    Batches that wait are taken in together, as many as have no more facts than the index then holds, where their fact ids are in
    the order of the batches, so that a fact with a smaller id is in the same or an earlier batch. The index is read and written
    a number of times that grows with the logarithm of the facts, however many batches they come in; each fact is probed once.
    """
    index = StatementIndex(facts.sparkSession, similarity=similarity)
    facts = facts.where(F.col("fact_id").isNotNull())
    spans = facts.groupBy("batch_id").agg(F.min("fact_id").alias("lo"), F.max("fact_id").alias("hi"), F.count("*").alias("n")).collect()
    first = min((r["batch_id"] for r in spans if r["batch_id"] is not None), default=0)
    facts = facts.withColumn("batch_id", F.coalesce("batch_id", F.lit(first)))
    out = facts.sparkSession.createDataFrame([], "first_id bigint, fact_id bigint")
    for lo, hi in taken_together([(first if r["batch_id"] is None else r["batch_id"], r["lo"], r["hi"], r["n"]) for r in spans]):
        out = out.unionByName(index.add(facts.where(F.col("batch_id").between(lo, hi))))
    return out
