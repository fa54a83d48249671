"""Text cut off by field limits (problem 10).

The corpus vocabulary is a trie, kept as a table of its nodes: beginnings of known words, and whether a node is a word
itself. Whether the last token is an unknown node with words below it, whether the text's length, in characters or bytes, is
one at which its source's texts pile up, and how the text ends are evidence; their sum decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.bits import bit_set, held
from cairn.operators.skew import salted_lookup
from cairn.session import stage

#: Phrases that close a complete text although it trails off.
TRAILING_OFF = (
    "more on this later", "more later", "to be continued", "we shall see", "we will see", "and so on", "mehr dazu später", "fortsetzung folgt", "wir werden sehen",
    "más detalles luego", "más adelante", "continuará", "ya veremos", "à suivre", "la suite plus tard", "on verra", "continua", "mais pormenores depois", "veremos",
    "продолжение следует", "подробности позже", "посмотрим", "далі буде", "подробиці згодом", "побачимо",
)
#: A word must stand in so many texts, not at their very end, to be known.
KNOWN_IN = 2
#: A length is a limit of a source if so many of the source's texts have it and it is this many times their neighbours'.
LIMIT_COUNT, LIMIT_TIMES = 5, 8
#: Evidence for a cut: of the last token (an unknown proper prefix of known words, a known word), of a length at a limit, of how the text ends (see ending(); trailing: a
#: mark after one of TRAILING_OFF). A sentence without end is enough by itself, since a cut between words leaves nothing else; a mark of omission is not.
PREFIX, KNOWN, AT_LIMIT = 2.0, -0.5, 2.0
ENDS = {"broken": 3.0, "code": 2.0, "open": 1.5, "omission": 1.5, "mark": 0.5, "trailing": -3.5, "line": -1.5, "closed": -4.0}
THRESHOLD = 1.0

_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"\s*(?:\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\)|…|\.{3,})\s*$")
_LAST = re.compile(r"([^\W_]+)$")
_CLOSED = re.compile(r"[.!?。！？؟:][\"'»”’)\]*_`]*$|[)\]»”\"’*`]$")
_TAGS = re.compile(r"^(?:#[\w-]+\s*)+$")
_SIGNATURE = re.compile(r"^(?:[—–]|--?)\s?\S+(?:\s\S+){0,3}$")
_KEY = re.compile(r"^\S+(?:/\S+)+$")
_VERSION = re.compile(r"^\D{0,12}\d+(?:\.\d+)+\S*$")
_RECORD = re.compile(r"^(?:[-*+•]\s+(?:\[[ xX]?\]\s*)?|\d+[.)]\s+|#+\s+)")


def ending(text: str) -> tuple[str, str, str]:
    """(kind, last token, phrase) of how a text ends.

    kind: empty; broken (half a character); code (open code block); mark (omission mark after an unfinished sentence,
    phrase being what stands between the sentence's start and the mark); line (a tag line, signature, key or version);
    omission (the same in brackets); closed (a sentence or block that is closed, or a sign like an emoji); open (nothing of these: no end of sentence).
    """
    body = text.rstrip()
    if not body:
        return "empty", "", ""
    if body[-1] == "�":
        return "broken", "", ""
    if body.count("```") % 2:
        return "code", "", ""
    if m := _MARK.search(body):
        rest = body[: m.start()]
        start = max((rest.rfind(c) for c in ".!?\n"), default=-1)
        phrase = rest[start + 1 :].strip()
        if not phrase:
            return "closed", "", ""
        token = _LAST.search(rest)
        return "omission" if m[0].strip()[0] in "[(" else "mark", token[1].lower() if token else "", " ".join(phrase.lower().split())
    token = _LAST.search(body)
    line = body[body.rfind("\n") + 1 :].strip()
    if token is None:
        # A comma, dash or opening bracket waits for more; any other sign closes.
        return ("open" if body[-1] in ",;-–—(/[{«„“&+=" else "closed"), "", ""
    last = token[1].lower()
    if _TAGS.match(line) or _KEY.match(line) or _VERSION.match(line) or (_SIGNATURE.match(line) and not _RECORD.match(line)):
        return "line", last, ""
    return "open", last, ""


def token_hash(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object)).view(np.int64) if words else np.empty(0, np.int64)


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        rows = [ending(t) for t in texts]
        kinds = ["trailing" if k == "mark" and p in TRAILING_OFF else k for k, _, p in rows]
        sizes = [[len(t) for t in texts], [len(t.encode()) for t in texts]]
        tokens = [r[1] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(x, pa.int32()) for x in sizes), pa.array(kinds, pa.string()), pa.array(tokens, pa.string()), pa.array(token_hash(tokens))], ["doc_id", "source", "chars", "bytes", "ending", "token", "h"]
        )


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of the batch each word is, the last token of each text apart."""
    for batch in batches:
        n: Counter = Counter()
        for text in batch.column(0).to_pylist():
            n.update(set(_WORD.findall(text.lower())[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])


def _nodes(bits: np.ndarray):
    """The trie's nodes that may be asked for: beginnings of the words, and whether they are the whole word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 5000):
                words = batch.column(0).slice(start, 5000).to_pylist()
                nodes = [w[:k] for w in words for k in range(1, len(w) + 1)]
                ends = np.concatenate([np.arange(1, len(w) + 1) == len(w) for w in words]) if words else np.empty(0, bool)
                keep = pa.array(held(bits, token_hash(nodes)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()).filter(keep), pa.array(ends).filter(keep)], ["node", "known"])

    return run


def trie(texts: DataFrame, asked: DataFrame, known_in: int = KNOWN_IN) -> DataFrame:
    """node, known: those beginnings of known words that are among the tokens asked for (h: their hashes) or hash like one, and whether the node itself is a known word."""
    words = texts.select("text").mapInArrow(_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= known_in)
    return words.select("word").mapInArrow(_nodes(bit_set(asked)), "node string, known boolean").groupBy("node").agg(F.max("known").alias("known"))


def limits(ends: DataFrame, length: str) -> DataFrame:
    """source, n: lengths at which a source's texts pile up, against the mean of the 20 lengths around."""
    counts = ends.groupBy("source", F.col(length).alias("n")).agg(F.count("*").alias("k"))
    around = F.sum("k").over(Window.partitionBy("source").orderBy("n").rangeBetween(-10, 10)) - F.col("k")
    return counts.withColumn("around", around / 20).where((F.col("k") >= LIMIT_COUNT) & (F.col("k") >= LIMIT_TIMES * F.col("around"))).select("source", "n")


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, source, ending, prefix, known, limit, score of every document with a text: the evidence, and its sum."""
    texts = documents.where(F.col("text").isNotNull() & (F.col("text") != "")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    # Texts are read for their endings, and once more for their words; all the rest is made of this small table.
    ends = stage(texts.mapInArrow(_endings, "doc_id bigint, source string, chars int, bytes int, ending string, token string, h bigint"), "ends")
    # Closed texts, most of them, have no last token to look up; many texts may end with one word, so the look-up is salted.
    asked = ends.where(F.col("token") != "")
    named = salted_lookup(asked, trie(texts, asked.select("h")).withColumnRenamed("node", "token"), "token", F.col("doc_id"))
    rows = named.unionByName(ends.where(F.col("token") == "").withColumn("known", F.lit(None).cast("boolean")))
    for length in ("chars", "bytes"):
        # A text of no source is compared with the limits of all sources.
        found = limits(ends, length)
        found = found.unionByName(found.select(F.lit(None).cast("string").alias("source"), "n")).distinct().select(F.col("source").alias("_s"), F.col("n").alias("_n"), F.lit(True).alias(f"_{length}"))
        rows = rows.join(found, F.col("source").eqNullSafe(F.col("_s")) & (F.col(length) == F.col("_n")), "left").drop("_s", "_n")
    prefix, known = F.coalesce(~F.col("known"), F.lit(False)), F.coalesce("known", F.lit(False))
    limit = F.coalesce("_chars", F.lit(False)) | F.coalesce("_bytes", F.lit(False))
    points = lambda flag, n: F.when(flag, F.lit(n)).otherwise(F.lit(0.0))
    end = F.element_at(F.create_map(*[F.lit(x) for kv in ENDS.items() for x in kv]), F.col("ending"))
    score = F.coalesce(end, F.lit(ENDS["closed"])) + points(prefix, PREFIX) + points(known, KNOWN) + points(limit, AT_LIMIT)
    return rows.select("doc_id", "source", "ending", prefix.alias("prefix"), known.alias("known"), limit.alias("limit"), score.alias("score"))


def cut_texts(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, source, why, score: the documents whose text is only the beginning of a longer one, by the sum of the evidence.

    why, the first that holds: character (half a character), word (the last token is no word but begins one), limit (the length is one
    of the source's limits), code (inside a code block), sentence (whole words, but the sentence has no end).
    Null and empty texts are not cut. The vocabulary and limits come from all documents; of few documents they know little, then only the
    ending counts. Repeated rows count each. Extra columns do not matter.
    """
    why = F.when(F.col("ending") == "broken", "character").when(F.col("prefix"), "word").when(F.col("limit"), "limit").when(F.col("ending") == "code", "code").otherwise("sentence")
    return scored(documents).where(F.col("score") >= threshold - 1e-9).select("doc_id", "source", why.alias("why"), "score")


def cut_by_source(documents: DataFrame, cut: DataFrame) -> DataFrame:
    """source, texts, cut, share: how often each source cuts."""
    all_ = documents.where(F.col("text").isNotNull() & (F.col("text") != "")).groupBy("source").agg(F.count("*").alias("texts"))
    few = cut.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("cut"))
    both = all_.join(few, F.col("source").eqNullSafe(F.col("_s")), "left")
    return both.select("source", "texts", F.coalesce("cut", F.lit(0)).alias("cut"), F.round(F.coalesce("cut", F.lit(0)) / F.col("texts"), 6).alias("share"))
