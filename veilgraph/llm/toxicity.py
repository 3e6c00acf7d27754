"""Toxicity by subword bags: averaged character n-gram vectors under a linear softmax.

A word's vector is the mean of the vectors of its character n-grams, so a
misspelling never seen shares most of its vectors with the word that was.  A
span of words has the mean of its words' vectors, a softmax over two classes
gives its score, and a text has the score of its most toxic span, so that a
long text does not dilute an insult.  Vectors and softmax are trained jointly
in numpy, each text standing for its currently most toxic span.

As averaging and the softmax's margin are linear, a word enters a score through
one number.  Scoring keeps those numbers in a bounded table of distinct words
in each Python worker and never shuffles; every span of the whole text counts.
Training takes one span in TRAINING_STEP, so that two spans of an insult do not
teach its neighbours: scores of held-out texts are better for it.

Defined results: a null or empty text has the score of no words (the bias
alone); repeated rows score alike; without labels of both classes every score
is the share of toxic labels; input columns that share a name with an output
column are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.llm.base import small_batches, text_of
from veilgraph.llm.labelled import is_held_out, labelled_sample

FOLDS, FOLD = 4, 2
THRESHOLD = 0.3
SPAN = 3
TRAINING_STEP = 2
BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (2, 3, 4, 5)
EPOCHS = 60
MIN_TEXTS = 5
RIDGE = 1e-7
MAX_TABLE_WORDS = 1_000_000
WORDS_AT_ONCE = 20_000
_PRIME = np.uint64(0x100000001B3)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "\"'.,;:!?()[]{}«»“”‘’…-–—"


@dataclass(frozen=True)
class FitSize:
    """Bounds of the labelled sample: texts per class, and characters of each that are used for fitting."""

    per_class: int = 1500
    max_chars: int = 3000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def gram_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, bucket) of every n-gram of the words between word marks, and of each whole word.

    In order of words.  Hashes are polynomials of code points, worked out for
    all positions of all words at once.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [f"<{w.strip(_EDGES) or w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.array([len(m) for m in marked])
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = ends[owner] - np.arange(len(codes))  # characters from here to the word's end
    power = np.cumprod(np.full(int(lengths.max()), _PRIME), dtype=np.uint64)
    whole = np.add.reduceat(codes * power[(lengths[owner] - left)], ends - lengths)
    owners, hashes = [np.arange(len(words))], [whole]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * _PRIME + codes[at + k]
        owners.append(owner[at])
        hashes.append(h)
    places, mixed = np.concatenate(owners), np.concatenate(hashes)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _PRIME
    buckets = ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)
    order = np.argsort(places, kind="stable")
    return places[order], buckets[order]


def span_starts(n_words: int, step: int = 1) -> range:
    """Every run of SPAN words, or one of ``step`` in such a way that the last reaches the end."""
    return range(0, max(1, n_words - SPAN + step), step)


@dataclass(frozen=True)
class SubwordModel:
    grams: np.ndarray  # (BUCKETS,): what an n-gram adds to the margin between the classes
    bias: float

    def margins(self, words: list[str]) -> list[float]:
        """What each word adds to the margin of a span, times the span's length."""
        out: list[float] = []
        for i in range(0, len(words), WORDS_AT_ONCE):
            some = words[i : i + WORDS_AT_ONCE]
            places, buckets = gram_table(some)
            total = np.bincount(places, self.grams[buckets], len(some))
            out += (total / np.bincount(places, minlength=len(some))).tolist()
        return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over [bounds[i], bounds[i + 1])."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


class _Adam:
    def __init__(self, shape: tuple, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def train(rows: list[tuple[str, int]], prior: float, seed: int = 7, epochs: int = EPOCHS) -> SubwordModel:
    """Vectors and softmax together, by gradient steps on cross entropy over spans.

    Every span of a clean text is an example of clean; a toxic text is one of
    toxic through all of its spans at first, later through its worst span only.
    N-grams of fewer than MIN_TEXTS texts get no vector: names and rare words
    would be learned by heart.
    """
    vocabulary: dict[str, int] = {}
    texts = [[vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)] for text, _ in rows]
    word_of, buckets = gram_table(list(vocabulary))
    # Unknown n-grams keep their place in the mean with a vector of zero.
    per_word = np.bincount(word_of, minlength=len(vocabulary)).astype(float)
    bounds = np.concatenate([[0], np.cumsum(per_word)]).astype(np.int64)
    texts_with = np.zeros(BUCKETS, np.int64)
    for ids in texts:
        own = [buckets[bounds[i] : bounds[i + 1]] for i in set(ids)]
        if own:
            texts_with[np.unique(np.concatenate(own))] += 1
    known = texts_with >= MIN_TEXTS
    learnt = known[buckets]
    gram, gram_sizes = buckets[learnt], np.bincount(word_of[learnt], minlength=len(vocabulary))
    gram_bounds = np.concatenate([[0], np.cumsum(gram_sizes)])

    spans = [ids[i : i + SPAN] for ids in texts for i in span_starts(len(ids), TRAINING_STEP)]
    text_bounds = np.cumsum([0, *(len(span_starts(len(ids), TRAINING_STEP)) for ids in texts)])
    tokens = np.array([i for span in spans for i in span], np.int64)
    span_bounds = np.cumsum([0, *map(len, spans)])
    sizes = np.diff(span_bounds)
    lengths = np.maximum(sizes, 1)
    y = np.array([label for _, label in rows])
    per_text = np.diff(text_bounds)
    owner = np.repeat(np.arange(len(rows)), per_text)
    of_span = y[owner]
    weight_of = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))

    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)) * known[:, None]
    softmax = random.normal(0, 0.5, (2, DIMENSIONS))
    bias = np.array([0.0, np.log(prior / (1 - prior))])
    adam = _Adam(vectors.shape, 0.1), _Adam(softmax.shape, 0.05), _Adam(bias.shape, 0.05)
    for epoch in range(epochs):
        # Only the margin between the classes matters, so sums run over one number per n-gram.
        axis = softmax[1] - softmax[0]
        word = _sums((vectors @ axis)[gram], gram_bounds) / per_word
        margin = _sums(word[tokens], span_bounds) / lengths + bias[1] - bias[0]
        order = np.lexsort((margin, owner))
        worst = np.zeros(len(spans), bool)
        worst[order[text_bounds[1:] - 1]] = True
        if epoch < epochs // 4:
            share = weight_of[owner] / per_text[owner]
        else:
            # A clean text counts half through its worst span, half through all.
            share = np.where(of_span == 1, worst, 0.5 * worst + 0.5 / per_text[owner]) * weight_of[owner]
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - of_span) * share
        by_word = np.bincount(tokens, np.repeat(error / lengths, sizes), len(per_word)) / per_word
        by_gram = np.bincount(gram, np.repeat(by_word, gram_sizes), BUCKETS)
        by_softmax = np.outer([-1.0, 1.0], by_gram @ vectors)
        vectors = vectors - adam[0].step(np.outer(by_gram, axis) + RIDGE * vectors)
        softmax = softmax - adam[1].step(by_softmax)
        bias = bias - adam[2].step(error.sum() * np.array([-1.0, 1.0]))
    margins = vectors @ (softmax[1] - softmax[0])
    return SubwordModel(np.where(known, margins, 0.0).astype(np.float32), float(bias[1] - bias[0]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, size: FitSize = FitSize()) -> SubwordModel:
    """Learn from labelled rows that are not held out; at most ``2 * size.per_class`` texts reach the driver."""
    rows, counts = labelled_sample(docs, labels, "toxic", FOLDS, FOLD, size.per_class, size.max_chars)
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    prior = min(max(share, 0.01), 0.99)
    if len({label for _, label in rows}) < 2:
        return SubwordModel(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    return train(rows, prior)


class WordTable(dict):
    """A word's share of the margin, worked out when the word is first met; bounded."""

    def __init__(self, model: SubwordModel):
        super().__init__()
        self.model = model

    def _learn(self, texts: list[list[str]]) -> None:
        new = {w for words in texts for w in words if w not in self}
        if len(self) + len(new) > MAX_TABLE_WORDS:
            self.clear()
            new = {w for words in texts for w in words}
        unknown = list(new)
        self.update(zip(unknown, self.model.margins(unknown)))

    def scores(self, texts: list[str]) -> list[float]:
        out: list[float] = []
        group: list[list[str]] = []
        size = 0
        for text in texts:  # a bounded number of words at once
            group.append(words_of(text))
            size += len(group[-1])
            if size > 100_000:
                out += self._scores(group)
                group, size = [], 0
        return out + self._scores(group)

    def _scores(self, texts: list[list[str]]) -> list[float]:
        self._learn(texts)
        return [self._score([self[w] for w in words]) for words in texts]

    def _score(self, values: list[float]) -> float:
        """The worst span's score; of no words, that of the bias alone."""
        worst = 0.0
        if values:
            starts = np.array(span_starts(len(values)))
            ends = np.minimum(starts + SPAN, len(values))
            total = np.concatenate([[0.0], np.cumsum(values)])
            worst = ((total[ends] - total[starts]) / (ends - starts)).max()
        return float(1 / (1 + np.exp(-np.clip(worst + self.model.bias, -700, 700))))


_TABLES: dict[tuple[int, float], WordTable] = {}


def _word_table(model: SubwordModel) -> WordTable:
    """Kept between the tasks of a Python worker; a new model replaces the old one."""
    key = (xxhash.xxh64_intdigest(model.grams.tobytes()), model.bias)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = WordTable(model)
    return _TABLES[key]


def score_toxicity(docs: DataFrame, model: SubwordModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, higher: toxic likelier) and ``predicted``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _word_table(shared.value)
        for texts in batches:
            yield pd.Series(words.scores(list(texts)), dtype=float)

    return docs.withColumns({"held_out": is_held_out(FOLDS, FOLD), "score": scored(text_of())}).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
