"""Words of texts and measures on them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_text(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def word_list(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, with repetition; [] for a text without any, null for null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


_WORD = re.compile(r"[^\W_]+")


def tokens(text: str, size: int = 1) -> list[str]:
    """Sorted shingles of `size` consecutive words (see word_list); the whole text as one if it has fewer words.

    Repeats of a shingle carry their number after a \\1, so that sets of tokens compare as shingles counted with repetition.
    """
    found = _WORD.findall(text.lower())
    if size > 1 and found:
        found = ["\2".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))]
    seen = Counter(found)
    out = list(seen)
    if len(out) < len(found):
        for w, n in seen.items():
            if n > 1:
                out += [f"{w}\1{k}" for k in range(2, n + 1)]
    out.sort()
    return out


#: Columns of 64 marks each. A token turns one of the marks over, so the marks in which two texts differ are at most as many as the tokens in which they do.
MARKS = ("m0", "m1", "m2", "m3")


def marks(docs: list[str], sizes: list[int]) -> list[np.ndarray]:
    """The marks of docs, which are tokens between blanks, `sizes` of them each, one at least."""
    if not docs:
        return [np.empty(0, np.int64) for _ in MARKS]
    coded = pc.split_pattern(pa.array(docs), " ").flatten().dictionary_encode()
    h = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object)).astype(np.uint64)[np.asarray(coded.indices)]
    bit, column, starts = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) % np.uint64(len(MARKS)), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return [np.bitwise_xor.reduceat(np.where(column == k, bit, np.uint64(0)), starts).view(np.int64) for k in range(len(MARKS))]


def _token_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sigs, sizes, docs = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = tokens(text, size)
                if own:
                    doc = " ".join(own)
                    ids.append(i)
                    sizes.append(len(own))
                    docs.append(doc)
                    sigs.append(int.from_bytes(blake2b(doc.encode(), digest_size=8).digest(), "little", signed=True))
            m = marks(docs, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(x) for x in m), pa.array(docs, pa.string())], ["id", "sig", "n", *MARKS, "doc"])

    return run


def token_rows(texts: DataFrame, id_col: str, text_col: str, size: int = 1) -> DataFrame:
    """id, sig, n, marks, doc: each text's tokens joined by blanks, their number, marks and hash, the same for texts with the same tokens. Texts without a word are left out."""
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_token_rows(size), f"id bigint, sig bigint, n int, {', '.join(f'{m} bigint' for m in MARKS)}, doc string")
