"""Language of texts by a linear-chain conditional random field over words.

A word (a run of letters, lower case) has hashed features: its byte trigrams, of which the first and last reach over the word's edge,
its three-byte prefix and suffix (affixes), and the word itself (lexicon). Each feature has a weight for each language, and a learned matrix
scores the language of a word after that of the word before it. Training maximises the likelihood of word labels in code-switched
sequences, spliced from pieces of texts of different languages; the sample is bounded (SAMPLE texts, of each a window of WINDOW words, out of at most TRAIN_CHARS characters at a hashed place). Prediction
runs forward-backward over all words of a text, vectorised over the texts of a batch, and averages the words' posteriors by length.

A text without a letter, and a null one, is "und" with score 0. A language is any non-null label of a training row with some text; without any,
every text is "und". Rows that repeat are predicted alike; an empty table gives no rows. Added columns replace input columns of their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import column, fold, packed, small_batches, table, unpacked
from .textbuf import NOT_LETTER, chunks, fold_case, mix, span_hashes, word_spans

SAMPLE, TRAIN_CHARS, WINDOW, EPOCHS = 2000, 20_000, 150, 4
BITS = 18
#: Bytes of text times languages that are worked on together.
CHUNK = 64 << 20
PIECE, PIECES = (4, 25), 8


class Words:
    """Words of a run of texts: flat feature numbers, with the first feature of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = fold_case(data)
        self.starts, self.stops, self.before = word_spans(data, offsets, NOT_LETTER)
        self.length = self.stops - self.starts
        # Separators, and the edges of texts, all count as a space.
        plain = np.where(NOT_LETTER[data], 32, data).astype(np.uint32)
        code = np.full(len(data) + 2, 32, np.uint32)
        code[1:-1] = plain
        left, right = code[:-2].copy(), code[2:].copy()
        left[self.starts] = 32
        right[self.stops - 1] = 32
        tri = (left << 16) | (code[1:-1] << 8) | right
        self.tri = self._bucket(tri, 1)
        self.inside = ~NOT_LETTER[data]
        high = np.uint64(64 - BITS)
        word = span_hashes(data, self.starts, self.stops)
        self.extra = np.stack([
            (word >> high).astype(np.int32),
            (mix(span_hashes(data, self.starts, np.minimum(self.stops, self.starts + 3)) + np.uint64(5)) >> high).astype(np.int32),
            (mix(span_hashes(data, np.maximum(self.starts, self.stops - 3), self.stops) + np.uint64(6)) >> high).astype(np.int32),
        ], axis=1) if len(word) else np.zeros((0, 3), np.int32)

    @staticmethod
    def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
        return ((x * np.uint32(0x9E3779B1) + np.uint32(salt)) >> np.uint32(32 - BITS)).astype(np.int32)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros((0, weights.shape[1]), np.float32)
        flat = weights[self.tri[self.inside]]
        first = np.cumsum(self.length) - self.length
        return np.add.reduceat(flat, first, axis=0) + weights[self.extra].sum(axis=1)

    def features(self, word: int) -> np.ndarray:
        return np.concatenate([self.tri[self.starts[word] : self.stops[word]], self.extra[word]])


def forward_backward(emissions: np.ndarray, transitions: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each word's label, and the forward and (emission included) backward messages, each scaled; all texts advance word by word together, the longest first."""
    em = np.exp(emissions - emissions.max(axis=1, keepdims=True)) + 1e-12 if len(emissions) else emissions
    step = np.exp(transitions - transitions.max())
    size = np.diff(before)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    at, active = before[:-1][order], np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), side="right")
    alpha, beta = np.empty_like(em), np.ones_like(em)
    for t, n in enumerate(active):
        i = at[:n] + t
        a = em[i] if t == 0 else (alpha[i - 1] @ step) * em[i]
        alpha[i] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        i = at[: active[t + 1]] + t
        b = (em[i + 1] * beta[i + 1]) @ step.T
        beta[i] = b / b.sum(axis=1, keepdims=True)
    out = alpha * beta
    return (out / out.sum(axis=1, keepdims=True) if len(out) else out), alpha, em * beta


class Field:
    """Feature weights and transitions of the random field."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.weights = np.zeros((1 << BITS, len(languages)), np.float32)
        self.transitions = np.zeros((len(languages), len(languages)))

    def fit(self, sequences: list[list[np.ndarray]], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 16, rate: float = 0.3, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        k = len(self.languages)
        square, step_square = np.full_like(self.weights, 1e-2), np.full((k, k), 1.0)
        for _ in range(epochs):
            order = rng.permutation(len(sequences))
            for start in range(0, len(order), batch):
                pick = order[start : start + batch]
                words = [w for i in pick for w in sequences[i]]
                y = np.concatenate([labels[i] for i in pick])
                before = np.concatenate([[0], np.cumsum([len(sequences[i]) for i in pick])])
                many = np.array([len(w) for w in words])
                flat, first = np.concatenate(words), np.cumsum(many) - many
                em = np.add.reduceat(self.weights[flat], first, axis=0).astype(np.float64)
                post, ahead, behind = forward_backward(em, self.transitions, before)
                error = post.copy()
                error[np.arange(len(y)), y] -= 1
                where, inverse = np.unique(flat, return_inverse=True)
                grad = np.zeros((len(where), k), np.float32)
                np.add.at(grad, inverse, np.repeat(error, many, axis=0).astype(np.float32))
                grad = grad / len(pick) + 1e-4 * self.weights[where]
                square[where] += grad * grad
                self.weights[where] -= rate * grad / np.sqrt(square[where])
                # Expected less observed transitions.
                inner = np.ones(len(y), bool)
                inner[before[:-1]] = False
                i = np.flatnonzero(inner)
                pair = ahead[i - 1][:, :, None] * np.exp(self.transitions)[None] * behind[i][:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                g = pair.sum(axis=0)
                np.subtract.at(g, (y[i - 1], y[i]), 1)
                g /= len(pick)
                step_square += g * g
                self.transitions -= rate * g / np.sqrt(step_square)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language, and its mean posterior, for each text; (-1, 0) without words."""
        best, score = [], []
        for _, data, offsets in chunks(column, CHUNK // max(4, len(self.languages))):
            words = Words(data, offsets)
            post, _, _ = forward_backward(words.emissions(self.weights).astype(np.float64), self.transitions, words.before)
            full = np.flatnonzero(np.diff(words.before))
            b, s = np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1)
            if len(full):
                weighed = np.add.reduceat(post * words.length[:, None], words.before[:-1][full], axis=0)
                weighed /= weighed.sum(axis=1, keepdims=True)
                b[full], s[full] = weighed.argmax(axis=1), weighed.max(axis=1)
            best.append(b)
            score.append(s)
        return (np.concatenate(best), np.concatenate(score)) if best else (np.zeros(0, int), np.zeros(0))


def spliced(texts: pa.Array, labels: np.ndarray, kinds: int, window: int, seed: int = 8) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
    """Sequences of word features with labels: pieces of a few words each, drawn from texts of all languages."""
    rng = np.random.default_rng(seed)
    pieces = []
    for row, data, offsets in chunks(texts):
        words = Words(data, offsets)
        for i in range(len(offsets) - 1):
            n = int(words.before[i + 1] - words.before[i])
            at = int(words.before[i]) + int(rng.integers(0, max(1, n - window + 1)))
            stop = min(at + window, int(words.before[i + 1]))
            while at < stop:
                to = min(stop, at + int(rng.integers(*PIECE)))
                pieces.append(([words.features(w) for w in range(at, to)], int(labels[row + i])))
                at = to
    order = rng.permutation(len(pieces))
    sequences, targets = [], []
    for start in range(0, len(order), PIECES):
        part = [pieces[i] for i in order[start : start + PIECES]]
        sequences.append([w for words, _ in part for w in words])
        targets.append(np.concatenate([np.full(len(words), y) for words, y in part]))
    return sequences, targets


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, window: int = WINDOW, train_chars: int = TRAIN_CHARS) -> Field | None:
    """A field from the rows given (the caller leaves out held-out ones). The driver gets at most sample texts of train_chars characters."""
    usable = docs.select(column(id_col).alias("id"), column(label_col).cast("string").alias("lang"), column(text_col).cast("string").alias("text")).filter("lang is not null and length(text) > 0")
    languages = sorted(r[0] for r in usable.select("lang").distinct().collect())  # one row a language
    if not languages:
        return None
    # Long texts lend a window at a hashed place, so every language is learned from however long its texts are.
    place = 1 + F.pmod(F.xxhash64("id", F.lit(29)), F.greatest(F.length("text") - train_chars, F.lit(0)) + 1)
    cut = usable.select("lang", F.xxhash64("id", F.lit(23)).alias("h"), F.substring("text", place.cast("int"), F.lit(train_chars)).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    got = cut.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max(1, sample // len(languages))).select("lang", "text", "h").orderBy("h", "lang", "text").toArrow()
    names = {x: i for i, x in enumerate(languages)}
    field = Field(languages)
    sequences, targets = spliced(got.column(1).combine_chunks(), np.array([names[x] for x in got.column(0).to_pylist()]), len(languages), window)
    field.fit(sequences, targets)
    return field


def identify(docs: DataFrame, field: Field | None, text_col: str = "text", to: str = "lang_pred", score_to: str = "score") -> DataFrame:
    """docs with the predicted language of each whole text and its mean posterior."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(field)
    text = column(text_col).cast("string")
    rows = docs.select(packed(docs, to, score_to), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for got in batches:
            letter = got.column(2).to_numpy(zero_copy_only=False)
            best, score = field.predict(got.column(1)) if field else (np.full(len(got), -1), np.zeros(len(got)))
            known = letter & (best >= 0)
            labels = [field.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(labels, pa.string()), pa.array(np.where(known, score, 0.0))], names=["row", "found", "sure"])

    found = rows.mapInArrow(run, rows.select("row").schema.add("found", "string").add("sure", "double"))
    return found.select(*unpacked(docs, to, score_to), F.col("found").alias(to), F.col("sure").alias(score_to))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = train(docs.filter(fold() != 2))
    out = identify(docs.select("doc_id", "text"), field)
    return out.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")
