"""Toxicity by compression distance.

Separate zstandard dictionaries are made from labelled text, one of ordinary documents and two of toxic
ones: each holds the words that are typical of its class, the toxic ones over the common language: words of
typical stems and typical whole words. Every window of a text is compressed with all; how much
shorter a toxic dictionary makes it, over thresholds, gives a document's features, and a logistic model,
calibrated on text that the dictionaries have not seen, turns them into a score.

Training reads a bounded sample of labelled documents (TRAIN_DOCS of each class, of at most
TRAIN_CHARS characters), never a document of the held-out fold; scoring reads every whole text.

Defined results: a null or empty text has no windows and gets the score of a text without any sign of
toxicity; a null id is not held out; an id with several labels is toxic if one says so; rows with the
same id are scored row by row; without toxic and ordinary training documents every score is 0; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, texts_of

#: Bounds of the training sample: documents of each class (toxic, ordinary), characters of one.
TRAIN_DOCS = (3000, 9000)
TRAIN_CHARS = 20_000
#: Words of a window, bytes of each dictionary.
WINDOW = 6
DICT_BYTES = 24_576
#: A substring of GRAM bytes is typical of toxic text if GRAM_DOCS toxic documents have it and its share among them
#: is GRAM_LIFT times its share among ordinary ones; a word, if one in WORD_DOCS of the toxic ones has it and its lift
#: is WORD_LIFT.
GRAM, GRAM_DOCS, GRAM_LIFT = 5, 5, 15.0
WORD_DOCS, WORD_LIFT = 60, 13.0
#: Parts of the training sample, each scored by dictionaries of the others.
FOLDS = 6
#: Bytes by which the toxic dictionary must win for a window to count, in steps.
GAINS = (2, 4, 6)
THRESHOLD, HELD_OUT = 0.3, 2
LEVEL = 4


def _grams(data: bytes) -> np.ndarray:
    """The substring of GRAM bytes at each position, as one number."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(b) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = (out << np.uint64(8)) | b[i : i + n]
    return out


def _typical_grams(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Sorted substrings typical of toxic documents. Only those that enough toxic ones have are
    counted in ordinary ones."""
    found, n = np.unique(np.concatenate([np.unique(_grams(t)) for t in toxic] or [np.zeros(0, np.uint64)]), return_counts=True)
    found, n = found[n >= GRAM_DOCS], n[n >= GRAM_DOCS]
    other = np.zeros(len(found), np.int64)
    for t in ordinary:
        g = np.unique(_grams(t))
        at = np.searchsorted(found, g)
        at = at[at < len(found)] if not len(g) else at
        ok = (at < len(found)) & (found[np.minimum(at, max(len(found) - 1, 0))] == g) if len(found) else np.zeros(len(g), bool)
        other[at[ok]] += 1
    return found[n / max(1, len(toxic)) > GRAM_LIFT * (other + 0.5) / max(1, len(ordinary))]


def _stemmed(data: bytes, grams: np.ndarray) -> set[bytes]:
    """The words of data that typical substrings cover at least by half, blanks around them counted."""
    out = set()
    if len(grams):
        for w in set(data.split()):
            w = w.strip(_EDGE)
            g = _grams(b" " + w + b" ")
            if len(g) and 2 * (grams[np.minimum(np.searchsorted(grams, g), len(grams) - 1)] == g).sum() >= len(g):
                out.add(w)
    return out


def _typical_words(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Whole words typical of toxic documents: where a stem is common to both classes, some of its forms are not."""
    least = max(2, -(-len(toxic) // WORD_DOCS))
    found, other = Counter(w for t in toxic for w in set(_words(t))), Counter()
    found = {w: n for w, n in found.items() if n >= least and len(w) > 2}
    for t in ordinary:
        other.update(set(_words(t)) & found.keys())
    return {w for w, n in found.items() if n / max(1, len(toxic)) > WORD_LIFT * (other[w] + 0.5) / max(1, len(ordinary))}


def _words(data: bytes) -> list[bytes]:
    return [w.strip(_EDGE) for w in data.split()]


def _content(words: Counter, size: int, least: int = 2) -> bytes:
    """A dictionary's content: the words that recur, the commonest last, where matches are cheapest."""
    out: list[bytes] = []
    room = size
    for w, n in sorted(words.items(), key=lambda x: (-x[1] * len(x[0]), x[0])):
        if n >= least and len(w) > 2 and len(w) + 1 <= room:
            out.append(w)
            room -= len(w) + 1
    return b" " + b" ".join(reversed(out)) + b" "


def distinct(texts: list[bytes]) -> list[bytes]:
    """texts without those of which a third of the lines were in an earlier one: copies of one document
    would make all of its words look typical."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        lines = {x for x in t.split(b"\n") if len(x) >= 20} or {t}
        if 3 * len(lines & seen) < len(lines):
            out.append(t)
        seen |= lines
    return out


def windows(data: bytes) -> list[bytes]:
    words = data.split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


_EDGE = b".,;:!?\"'()"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(_LOWER)


@dataclass
class Model:
    ordinary: bytes = b""  # dictionary contents
    toxic: list[bytes] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = -50.0

    def gains(self):
        """A function from a text's bytes to the bytes that each toxic dictionary saves per window, a row a dictionary."""
        import zstandard as zs

        def coder(content: bytes):
            if len(content) < 8:
                return zs.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress
            own = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            return zs.ZstdCompressor(dict_data=own, level=LEVEL, write_content_size=False, write_checksum=False).compress

        a, *own = map(coder, (self.ordinary, *self.toxic))

        def run(data: bytes) -> np.ndarray:
            parts = windows(data)
            least = np.array([len(a(w)) for w in parts], np.int64)
            return np.array([least - [len(c(w)) for w in parts] for c in own], np.int64).reshape(len(own), len(parts))

        return run

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights) + self.bias, -500, 500)))


def features(gains: np.ndarray) -> list[float]:
    """Of each dictionary: windows over each threshold, as logarithms and as shares, the three best windows, and what
    the windows over the first threshold gain, over all windows; then the text's length."""
    n, out = gains.shape[1], []
    for gain in gains:
        over = [int((gain >= g).sum()) for g in GAINS]
        best = np.sort(gain)[-3:].clip(0)
        out += [*(np.log1p(x) for x in over), *(min(1.0, 10 * x / max(1, n)) for x in over), float(best.sum()) / 10, min(5.0, float(gain[gain >= GAINS[0]].sum()) / max(1, n))]
    return [*out, float(np.log1p(n))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[list[float], float]:
    """Newton's method, a small fixed penalty on the weights."""
    x1 = np.c_[x, np.ones(len(x))]
    beta, penalty = np.zeros(x1.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        grad = x1.T @ (weight * (y - p)) - penalty * beta
        hess = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-7:
            break
    return beta[:-1].tolist(), float(beta[-1])


def train(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """A model from texts of both classes; share: of toxic documents in the population.

    The weights come from each fold's features by dictionaries of the other folds, which have not seen its windows;
    the dictionaries are then made from all."""
    t, o = distinct([_bytes(x) for x in toxic]), distinct([_bytes(x) for x in ordinary])
    if not t or not o:
        return Model()

    def dictionaries(t: list[bytes], o: list[bytes]) -> Model:
        common = _content(Counter(w for x in o for w in x.split()), DICT_BYTES // 2)
        grams, typical = _typical_grams(t, o), _typical_words(t, o)
        stems = _content(Counter(w for x in t for w in _stemmed(x, grams)), DICT_BYTES // 2)
        words = _content(Counter(w for x in t for w in _words(x) if w in typical), DICT_BYTES // 2)
        return Model(ordinary=common, toxic=[common + stems, common + words])

    rest = lambda x, i: [d for k, d in enumerate(x) if k % FOLDS != i]
    x, y = [], []
    for i in range(FOLDS):
        gains = dictionaries(rest(t, i), rest(o, i)).gains()
        for texts, label in ((t[i::FOLDS], 1.0), (o[i::FOLDS], 0.0)):
            x += [features(gains(d)) for d in texts]
            y += [label] * len(texts)
    x, y = np.array(x), np.array(y)
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    model = dictionaries(t, o)
    model.weights, model.bias = _logistic(x, y, weight)
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on the bounded sample, drawn by hash of the id from labelled documents not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col(f"`{id_col}`").isNotNull()).filter(~held_out(id_col)).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Model()
    drawn = None
    for label, most in zip((1, 0), TRAIN_DOCS):
        one = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        drawn = one if drawn is None else drawn.unionByName(one)
    # at most sum(TRAIN_DOCS) ids, whatever the corpus
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).filter(F.length("text") <= TRAIN_CHARS)
    rows = text.join(F.broadcast(drawn), "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")).collect()
    rows.sort(key=lambda r: r["id"])
    return train([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0], n[1] / (n[0] + n[1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the windows that count, one row per document."""

    def make():
        gains = model.gains()

        def step(batch):
            found = [gains(_bytes(t)) for t in texts_of(batch)]
            s = model.score(np.array([features(g) for g in found]))
            counted = [int((g[:1] >= GAINS[1]).sum()) for g in found]
            yield {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32), "n_toxic_windows": counted}

        return step

    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("held_out"))
    return arrow_map(src, f"doc_id {kind}, held_out boolean, score double, predicted int, n_toxic_windows long", make)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
