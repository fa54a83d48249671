"""Evaluation texts leaking into training text (problem 9).

An item leaks into a document if the document holds a window of `window` consecutive words of the item. Documents and
windows are sets of shingles of SHINGLE words, ordered by rarity over all documents. A window is joined by its rarest shingle
alone, the prefix that containment of the whole window needs; a document must be long enough around it, and the window
is then verified word by word.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.bits import bit_set, held
from cairn.llm.near import mix
from cairn.operators.skew import salted_lookup
from cairn.session import stage

WINDOW, SHINGLE = 8, 3
_SLICE = 1000
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
#: Signs that do not show: all of Unicode's format class, the combining grapheme joiner and variation selectors.
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
#: Rows of documents: runs of words (h null), and how often each shingle h is in the documents of a slice (doc_id null).
RUNS = "doc_id bigint, run string, h bigint, n bigint"
SPOTS = "h bigint, before int, context string"


def plain_words(text: str | None) -> list[str]:
    """Words without regard to case, punctuation, markup, spacing, line breaks and invisible characters; [] for null."""
    if not text:
        return []
    text = _HIDDEN.sub("", text)
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if "&" in text:
        text = _HIDDEN.sub("", html.unescape(text))
    if "<" in text:
        text = _TAG.sub("", text)
    if "\n" in text:
        text = _HYPHEN.sub("", text)
    return _WORD.findall(text.lower())


def shingle_hashes(lists: list[list[str]], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles that begin at each word of all lists, one after the other; whether a whole shingle does; and where each list begins."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    total = int(starts[-1])
    if not total:
        return np.empty(0, np.int64), np.empty(0, bool), starts
    coded = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
    of = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object)).astype(np.uint64)[np.asarray(coded.indices)]
    h = np.zeros(total, np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + np.concatenate([of[k:], np.zeros(min(k, total), np.uint64)]))
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(total)
    return h.view(np.int64), left >= size, starts


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, words of the whole item, of the item without its last sentence, and of that sentence (null for an item of one sentence)."""
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text and text.strip():
                parts = _SENTENCE.split(text.strip())
                values = (i, " ".join(plain_words(text)), " ".join(plain_words(" ".join(parts[:-1]))), " ".join(plain_words(parts[-1])) if len(parts) > 1 else None)
                for c, v in zip(rows, values):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(c, pa.string()) for c in rows[1:])], ["item_id", "whole", "body", "last"])


def item_texts(items: DataFrame) -> DataFrame:
    """item_id, words: the items' words without standing instructions, which are last sentences that two or more items end with."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(_item_words, "item_id bigint, whole string, body string, last string")
    standing = rows.where(F.col("last").isNotNull()).groupBy("last").count().where(F.col("count") > 1).select("last", F.lit(True).alias("standing"))
    return rows.join(standing, "last", "left").select("item_id", F.when(F.coalesce("standing", F.lit(False)), F.col("body")).otherwise(F.col("whole")).alias("words"))


def _item_shingles(window: int, size: int):
    """Rows (item_id, number, at, h, words): each shingle of each window, at its place in it; windows are numbered within their item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [t.split(" ") if t else [] for t in batch.column(1).to_pylist()]
            h, _, starts = shingle_hashes(lists, size)
            out: list[list] = [[], [], [], [], []]
            for i, x, s in zip(batch.column(0).to_pylist(), lists, starts[:-1].tolist()):
                for k in range(len(x) - window + 1):
                    words = " ".join(x[k : k + window])
                    for at in range(window - size + 1):
                        for c, v in zip(out, (i, k, at, int(h[s + k + at]), words)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["item_id", "number", "at", "h", "words"])

    return run


def _runs(bits: np.ndarray, window: int, size: int):
    """RUNS of documents (doc_id, text): the longest runs of words whose shingles may all be an item's, if they are as long as a window;
    and counts of the shingles that may be an item's, wherever they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                lists = [plain_words(t) for t in batch.column(1).to_pylist()]
                h, full, starts = shingle_hashes(lists, size)
                may = full & held(bits, h) if len(h) else full
                seen, n = np.unique(h[may], return_counts=True)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], may, [False]]).astype(np.int8)))
                a, b = edge[::2], edge[1::2]
                long = b - a >= window - size + 1
                a, b = a[long], b[long]
                doc = np.searchsorted(starts, a, side="right") - 1
                own = [" ".join(lists[d][x - starts[d] : y - starts[d] + size - 1]) for d, x, y in zip(doc.tolist(), a.tolist(), b.tolist())]
                none = lambda k, t: pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(own, pa.string()), none(len(own), pa.int64()), none(len(own), pa.int64())], ["doc_id", "run", "h", "n"])
                yield pa.RecordBatch.from_arrays([none(len(seen), pa.int64()), none(len(seen), pa.string()), pa.array(seen), pa.array(n.astype(np.int64))], ["doc_id", "run", "h", "n"])

    return run


def _spots(window: int, size: int):
    """Rows (doc_id, h, before, context) of each shingle of a run (doc_id, run): the words around it that a window with it may hold, and how many of them come before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [t.split(" ") for t in batch.column(1).to_pylist()]
            h, full, starts = shingle_hashes(lists, size)
            doc, key, before, context = [], [], [], []
            for d, x, s in zip(batch.column(0).to_pylist(), lists, starts[:-1].tolist()):
                for p in range(len(x) - size + 1):
                    lo = max(0, p - window + size)
                    doc.append(d), key.append(int(h[s + p])), before.append(p - lo), context.append(" ".join(x[lo : p + window]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(before, pa.int32()), pa.array(context, pa.string())], ["doc_id", "h", "before", "context"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, window: int = WINDOW, size: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, windows: the items that leaked into each document, and how many of an item's windows it holds.

    documents: doc_id, text; items: item_id, text. Null and empty texts hold nothing, items of fewer than `window` words (the
    instruction apart) leak nowhere. Copies of a document or an item count each. Extra columns do not matter.

    Documents are read once, whole. Every word in a leaked window begins or continues a shingle of an item, so only runs of such
    words, as long as a window, leave the scan; a set of bits of the items' shingles, of a fixed size, tells them. Items stay on the executors too.
    """
    parts = stage(item_texts(items).mapInArrow(_item_shingles(window, size), "item_id bigint, number int, at int, h bigint, words string"), "windows")
    bits = bit_set(parts.select("h"))
    found = stage(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull()).mapInArrow(_runs(bits, window, size), RUNS), "runs")
    counts = found.where(F.col("h").isNotNull()).groupBy("h").agg(F.sum("n").alias("n"))
    # The rarest shingle of each window; a window with a shingle that no document has is in no document.
    rarest = parts.join(counts, "h").groupBy("item_id", "number").agg(F.count("*").alias("k"), F.min(F.struct("n", "h", "at", "words")).alias("r"))
    keys = rarest.where(F.col("k") == window - size + 1).select("item_id", "number", "r.h", "r.at", "r.words")
    spots = found.where(F.col("h").isNull()).select("doc_id", "run").mapInArrow(_spots(window, size), f"doc_id bigint, {SPOTS}")
    near = salted_lookup(spots, keys, "h", F.struct("doc_id", "context"), how="inner")
    # Positional bounds: as many words before the shingle as in the window, and enough after it.
    near = near.withColumn("c", F.split("context", " ")).where((F.col("before") >= F.col("at")) & (F.size("c") - F.col("before") >= window - F.col("at")))
    same = F.array_join(F.slice("c", F.greatest(F.col("before") - F.col("at") + 1, F.lit(1)), window), " ") == F.col("words")
    return near.where(same).select("doc_id", "item_id", "number").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"))
