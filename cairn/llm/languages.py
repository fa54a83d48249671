"""Missing or wrong document language labels (problem 1).

Hierarchical discrimination: linear support vector machines first tell language families apart, then, within a family,
one machine for each pair of its languages votes. Features are words and their letter n-grams. A text is judged
sentence by sentence, so that texts in several languages come apart into segments.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The languages by family.
FAMILIES = {"slavic": ("ru", "uk"), "germanic": ("de", "en"), "romance": ("es", "fr", "pt")}
LANGUAGES = tuple(sorted(x for f in FAMILIES.values() for x in f))
#: Names that labels give languages, besides two-letter codes.
NAMES = {
    "en": ("eng", "english", "anglais", "englisch", "inglés", "inglês", "английский", "англійська"),
    "ru": ("rus", "russian", "русский", "russe", "russisch", "ruso", "russo", "російська"),
    "de": ("deu", "ger", "german", "deutsch", "allemand", "alemán", "alemão", "немецкий", "німецька"),
    "fr": ("fra", "fre", "french", "français", "francais", "französisch", "francés", "francês", "французский", "французька"),
    "es": ("spa", "spanish", "español", "espanol", "castellano", "espagnol", "spanisch", "espanhol", "испанский", "іспанська"),
    "pt": ("por", "portuguese", "português", "portugues", "portugais", "portugiesisch", "portugués", "португальский", "португальська"),
    "uk": ("ukr", "ukrainian", "українська", "ukrainien", "ukrainisch", "ucraniano", "украинский"),
}
#: Labelled texts of each language that the machines are fitted on, at most; and sentences of each text, spread over it.
TEXTS, SENTENCES = 1000, 4
DIMENSIONS = 1 << 13
#: Words that a segment needs to count as a language of its own text.
LEAST_WORDS = 5
LEAST_MARGIN = 0.45
CHUNK = 30

_FENCE = re.compile(r"```.*?(?:```|$)", re.S)
_NOISE = re.compile(r"\S*[/@_#\\<>{}=]\S*?(?=[.!?…,;:]*(?:\s|$))")
_PARTS = re.compile(r"\b[^\W\d_]+(?:['’][^\W\d_]+)*\b|[.!?…](?=\s|$)|\n")


def label_language(label: Column) -> Column:
    """Two-letter code that a label names in any spelling, case, regional or three-letter form; null if it names none of LANGUAGES."""
    t = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)^[\s\"']+|[\s\"']+$", ""))
    base = F.regexp_extract(t, r"^(\p{L}+)(?:[-_].*)?$", 1)
    table = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in (code, *names) for x in (n, code)])
    return F.try_element_at(table, base)


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence or line, lower-cased, without code, paths, addresses and tags; long ones in chunks."""
    if "`" in text:
        text = _FENCE.sub("\n", text)
    if any(c in text for c in "/@_#\\<{="):
        text = _NOISE.sub(" ", text)
    out, now = [], []
    for part in _PARTS.findall(text.lower()):
        if part in ".!?…\n":
            if now:
                out.append(now)
                now = []
        else:
            now.append(part)
            if len(now) == CHUNK:
                out.append(now)
                now = []
    if now:
        out.append(now)
    return out


def features(word: str) -> np.ndarray:
    """Hashed features of a word: itself, its beginning and end, its trigrams, its script and its letters beyond a to z."""
    w = f"^{word}$"
    script = "cyrillic" if "а" <= word[0] <= "ӿ" else "latin" if word[0] < "ɐ" else "other"
    grams = [w, w[:3], w[:4], w[-3:], w[-4:], *(w[i : i + 3] for i in range(1, len(w) - 3)), script, *(c for c in word if c > "z" and not "а" <= c <= "я")]
    return np.array([zlib.crc32(g.encode()) % DIMENSIONS for g in grams])


def fit_svm(rows: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, rounds: int = 60, c: float = 1e-5) -> np.ndarray:
    """Weights (last: bias) of a linear SVM with squared hinge loss and y in {-1, 1}, by accelerated gradient steps.

    rows: feature indices, their values, and the first index of each row. All sums run in a fixed order: the same input gives the same machine.
    """
    index, value, starts = rows
    n = np.diff(np.append(starts, len(index)))
    w = np.zeros(DIMENSIONS + 1)
    look, t = w, 1.0
    share = 1 / len(y)
    # The loss curves at most twice the mean squared length of a row.
    rate = 1 / (2 * share * float(np.add.reduceat(value * value, starts).sum()) + c) if len(y) else 0.0
    rate *= 4  # rows are far from parallel; the restart below catches a step too long
    before = np.inf
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * np.add.reduceat(value * look[index], starts))
        loss = share * float(slack @ slack) + c * float(look @ look)
        grad = np.bincount(index, weights=value * np.repeat(-2 * share * slack * y, n), minlength=DIMENSIONS + 1) + 2 * c * look
        if loss > before:
            t, rate, look = 1.0, rate / 2, w
            before = np.inf
            continue
        new = look - rate * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t, before = new + (t - 1) / t2 * (new - w), new, t2, loss
    return w.astype(np.float32)


@dataclass
class LanguageModel:
    """Pairs of classes (families or languages of one family) and the weights of each pair's machine."""

    pairs: list[tuple[str, str]]
    weights: np.ndarray  # features + 1 x pairs
    scale: float = 1.0
    _rows: dict[str, int] = field(default_factory=dict)
    _table: np.ndarray | None = None

    @staticmethod
    def rows(sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows of sentences: every word's features, each word as heavy as any other, and the bias."""
        known: dict[str, np.ndarray] = {}
        index, value, starts, at = [], [], [], 0
        for s in sents:
            starts.append(at)
            for w in s:
                f = known.get(w)
                if f is None:
                    f = known[w] = features(w)
                index.append(f)
                value.append(np.full(len(f), 1 / np.sqrt(len(f) * len(s)), np.float32))
                at += len(f)
            index.append(np.array([DIMENSIONS]))
            value.append(np.ones(1, np.float32))
            at += 1
        return np.concatenate(index), np.concatenate(value), np.array(starts)

    @classmethod
    def fit(cls, sents: list[list[str]], labels: list[str]) -> LanguageModel:
        y, keep = np.array(labels), np.ones(len(labels), bool)
        family = {code: f for f, codes in FAMILIES.items() for code in codes}
        fam = np.array([family[a] for a in y])
        pairs = [*combinations(FAMILIES, 2), *(p for codes in FAMILIES.values() for p in combinations(codes, 2))]
        model = cls(pairs, np.zeros((DIMENSIONS + 1, len(pairs)), np.float32))
        index, value, starts = cls.rows(sents)
        n = np.diff(np.append(starts, len(index)))
        for last in (False, True):  # the second fit leaves out sentences whose label the first one contradicts
            for k, (a, b) in enumerate(pairs):
                of = fam if a in FAMILIES else y
                mine = ((of == a) | (of == b)) & keep
                if mine.any():
                    part = np.repeat(mine, n)
                    own = (index[part], value[part], np.concatenate([[0], np.cumsum(n[mine])[:-1]]))
                    model.weights[:, k] = fit_svm(own, np.where(of[mine] == a, 1.0, -1.0))
            if not last:
                guess = model.classify(sents)[0]
                keep = np.array([LANGUAGES[g] == a for g, a in zip(guess, y)])
                model._table = None
        model._table, model._rows = None, {}
        return model

    def choose(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language (index into LANGUAGES) and margin of rows of machine scores."""
        votes = np.zeros((len(scores), len(FAMILIES)), np.float32)
        names = list(FAMILIES)
        for k, (a, b) in enumerate(self.pairs):
            if a in FAMILIES:
                s = np.clip(scores[:, k], -1, 1)
                votes[:, names.index(a)] += s
                votes[:, names.index(b)] -= s
        fam = votes.argmax(axis=1)
        top = np.sort(votes, axis=1)
        margin = (top[:, -1] - top[:, -2]) / len(names)
        lang = np.zeros(len(scores), np.int64)
        for f, name in enumerate(names):
            rows = np.flatnonzero(fam == f)
            own = np.zeros((len(rows), len(LANGUAGES)), np.float32) - 9
            for code in FAMILIES[name]:
                own[:, LANGUAGES.index(code)] = 0
            for k, (a, b) in enumerate(self.pairs):
                if a in FAMILIES[name]:
                    s = np.clip(scores[rows, k], -1, 1)
                    own[:, LANGUAGES.index(a)] += s
                    own[:, LANGUAGES.index(b)] -= s
            lang[rows] = own.argmax(axis=1)
            top = np.sort(own, axis=1)
            margin[rows] = np.minimum(margin[rows] * 1.5, (top[:, -1] - top[:, -2]) / 2)
        return lang, margin

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Sums over each word's features, one row a word; rows of words seen before are kept, up to a bound."""
        if self._table is None or len(self._rows) > 400_000:
            self._rows, self._table = {}, np.zeros((1024, len(self.pairs)), np.float32)
        ids = np.empty(len(words), np.int64)
        rows = self._rows
        for i, w in enumerate(words):
            k = rows.get(w)
            if k is None:
                k = rows[w] = len(rows)
                if k >= len(self._table):
                    self._table = np.concatenate([self._table, np.zeros_like(self._table)])
                f = features(w)
                self._table[k] = self.weights[f].sum(axis=0) / np.sqrt(len(f))
            ids[i] = k
        return self._table[ids]

    def classify(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Language and margin of each sentence (all with a word at least)."""
        n = np.array([len(s) for s in sents])
        sums = np.add.reduceat(self.word_scores([w for s in sents for w in s]), np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
        return self.choose(sums / np.sqrt(n)[:, None] + self.weights[-1])


def training_texts(labelled: DataFrame, texts: int = TEXTS) -> list[tuple[str, str]]:
    """(text, language) of at most `texts` different texts of each language, those of the least hashes. labelled: text, lang (null left out).

    The number of different texts of each language, counted over all rows, gives a bound that about twice as many hashes as wanted
    lie under; only texts under it are looked at again. Nothing else is shuffled or sent, whatever the number of rows or partitions.
    """
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 30)).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return []
    bound = {k: -(2**63) + int(2**64 * min(1.0, 2 * texts / max(1, n))) - 1 for k, n in counts.items()}
    under = F.element_at(F.create_map(*[F.lit(x) for kv in bound.items() for x in kv]), F.col("lang"))
    few = rows.where(F.col("h") <= under).groupBy("lang", "h").agg(F.min("text").alias("text"))
    kept: dict[str, list] = {}
    for r in few.collect():
        kept.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return [(text, lang) for lang, own in kept.items() for _, text in sorted(own)[:texts]]


def fit_languages(labelled: DataFrame, texts: int = TEXTS) -> LanguageModel:
    sents, labels = [], []
    for text, lang in sorted(training_texts(labelled, texts)):
        fit = [s for s in sentences(text) if len(s) >= 3]
        for s in fit[:: max(1, len(fit) // SENTENCES)][:SENTENCES]:
            sents.append(s)
            labels.append(lang)
    return LanguageModel.fit(sents, labels) if sents else LanguageModel([], np.zeros((DIMENSIONS + 1, 0), np.float32))


def segment(model: LanguageModel, texts: list[str | None], least_margin: float = LEAST_MARGIN) -> list[list[tuple[int, str, int, float]]]:
    """Segments of each text: (number, language, words, confidence), neighbours of one language being one segment.

    Sentences of fewer than LEAST_WORDS words or of a small margin go with the sentences around them (the one before, else
    the one after). A text of such sentences alone is one segment of the language that fits it best. Null, empty and wordless texts have none.
    """
    split = [sentences(t) if t else [] for t in texts]
    flat = [s for x in split for s in x]
    if not flat:
        return [[] for _ in texts]
    lang, margin = model.classify(flat)
    out, at = [], 0
    for x in split:
        mine = range(at, at + len(x))
        at += len(x)
        sure = [i for i in mine if len(flat[i]) >= LEAST_WORDS and margin[i] >= least_margin]
        if not sure:
            if not x:
                out.append([])
                continue
            words = [w for s in x for w in s]
            a, m = model.classify([words])
            out.append([(0, LANGUAGES[a[0]], len(words), _confidence(m[0]))])
            continue
        named: list[list] = []
        own = {i: int(lang[i]) for i in sure}
        now = own[sure[0]]
        for i in mine:
            now = own.get(i, now)
            if not named or named[-1][0] != now:
                named.append([now, 0, 0.0, 0])
            seg = named[-1]
            seg[1] += len(flat[i])
            if i in own:
                seg[2] += float(margin[i]) * len(flat[i])
                seg[3] += len(flat[i])
        out.append([(k, LANGUAGES[s[0]], s[1], _confidence(s[2] / max(1, s[3]))) for k, s in enumerate(named)])
    return out


def _confidence(margin: float) -> float:
    return round(float(1 / (1 + np.exp(-8 * margin))), 4)


def _segments(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                found = segment(model, batch.column(batch.num_columns - 1).to_pylist())
                rows = pa.array([i for i, s in enumerate(found) for _ in s], pa.int64())
                kept = [c.take(rows) for c in batch.columns[:-1]]
                parts = [pa.array([s[k] for segs in found for s in segs], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*kept, *parts], [*batch.schema.names[:-1], "segment", "lang", "words", "confidence"])

    return run


def text_languages(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """src, row_id, label, segment, lang, words, confidence: every segment of every text. texts: src, row_id, label, text.

    A table is read once, without a shuffle. Null, empty and wordless texts have no segments; repeated rows count each.
    """
    return texts.select("src", F.col("row_id").cast("bigint").alias("row_id"), "label", "text").where(F.col("text").isNotNull()).mapInArrow(_segments(model), "src string, row_id bigint, label string, segment int, lang string, words int, confidence double")


def _wrong(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                src, row, lang, conf = [], [], [], []
                for s, i, label, segs in zip(*(batch.column(k).to_pylist() for k in range(3)), segment(model, batch.column(3).to_pylist())):
                    held: dict[str, list[float]] = {}
                    for _, name, words, c in segs:
                        held.setdefault(name, [0, 0.0])
                        held[name][0] += words
                        held[name][1] = max(held[name][1], c)
                    most = max(held, key=lambda n: held[n][0], default=None)
                    names = [n for n in sorted(held) if n == most or held[n][0] >= LEAST_WORDS]
                    if names and names != [label]:
                        for n in names:
                            src.append(s), row.append(i), lang.append(n), conf.append(held[n][1])
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(row, pa.int64()), pa.array(lang, pa.string()), pa.array(conf, pa.float64())], ["src", "row_id", "lang", "confidence"])

    return run


def mislabelled(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """src, row_id, lang, confidence: one row for each language of a text whose label (normalised code or null) is not its only language."""
    return texts.select("src", F.col("row_id").cast("bigint").alias("row_id"), "label", "text").where(F.col("text").isNotNull()).mapInArrow(_wrong(model), "src string, row_id bigint, lang string, confidence double")


def labelled_texts(memories: DataFrame, commands: DataFrame, documents: DataFrame) -> DataFrame:
    """src, row_id, label, text of the three tables, the label as a two-letter code or null."""
    return (
        memories.select(F.lit("memories").alias("src"), F.col("seq").alias("row_id"), label_language(F.col("value.metadata")["lang"]).alias("label"), F.col("value.content").alias("text"))
        .unionByName(commands.select(F.lit("agent_commands").alias("src"), F.col("command_id").alias("row_id"), label_language(F.col("lang")).alias("label"), "text"))
        .unionByName(documents.select(F.lit("documents").alias("src"), F.col("doc_id").alias("row_id"), label_language(F.col("lang")).alias("label"), "text"))
    )
