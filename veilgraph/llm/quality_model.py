"""Quality classifier by compression: a text resembles the class whose dictionary compresses it better.

Two Zstandard dictionaries are built from pieces of good and of bad texts.  A
text is cut into pieces, each compressed with either dictionary; the difference
of the two total sizes over the text's size is the feature, and a logistic
curve fitted on other labelled texts turns it into a score.

Fitting takes a bounded sample (``FitSize``); scoring covers every whole text,
one text at a time, without a shuffle.

Defined results: a null or empty text has the feature 0 and so the same score
everywhere; repeated rows score alike; without labels of both classes every
score is the share of good labels (0.5 without any); input columns that share a
name with an output column are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.llm.base import small_batches, text_of
from veilgraph.llm.labelled import is_held_out, labelled_sample

PIECE_BYTES = 1024
DICTIONARY_BYTES = 112_640
LEVEL = 3
FOLDS, FOLD = 5, 0
THRESHOLD = 0.3


@dataclass(frozen=True)
class FitSize:
    """Bounds of the labelled sample: texts per class, and characters of each that are used for fitting."""

    per_class: int = 3000
    max_chars: int = 8192


def _pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "replace")
    return [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        def one(content: bytes) -> zstandard.ZstdCompressor:
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False
            )

        return one(self.good), one(self.bad)


def feature(text: str, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """(size with the bad dictionary - size with the good one) / plain size."""
    total = plain = 0
    for piece in _pieces(text):
        total += len(bad.compress(piece)) - len(good.compress(piece))
        plain += len(piece)
    return total / plain if plain else 0.0


def _dictionary(texts: list[str]) -> bytes:
    samples = [p for text in texts for p in _pieces(text)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: they are the dictionary themselves
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton steps with a small ridge."""
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        ridge = np.diag([1e-3, 1e-6])
        gradient = design.T @ (weight * (y - p)) - ridge @ beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit_quality(docs: DataFrame, labels: DataFrame, size: FitSize = FitSize()) -> CompressionModel:
    """Learn from labelled rows that are not held out; at most ``2 * size.per_class`` texts reach the driver."""
    rows, counts = labelled_sample(docs, labels, "quality", FOLDS, FOLD, size.per_class, size.max_chars)
    texts = {value: [t for t, label in rows if label == value] for value in (0, 1)}
    if not texts[0] or not texts[1]:
        share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
        share = min(max(share, 0.01), 0.99)
        return CompressionModel(b"\n" * 8, b"\n" * 8, 0.0, float(np.log(share / (1 - share))))
    # Every second text builds the dictionaries, the others calibrate; a single text does both.
    built = {value: _dictionary(found[::2]) for value, found in texts.items()}
    good, bad = CompressionModel(built[1], built[0], 0.0, 0.0).compressors()
    x, y, weight = [], [], []
    for value, found in texts.items():
        rest = found[1::2] or found
        x += [feature(text, good, bad) for text in rest]
        y += [value] * len(rest)
        weight += [counts[value] ** 0.5 / len(rest)] * len(rest)
    w = np.array(weight)
    slope, offset = _logistic(np.array(x), np.array(y, float), w * len(w) / w.sum())
    return CompressionModel(built[1], built[0], slope, offset)


_COMPRESSORS: dict[tuple[int, int], tuple] = {}


def _compressors(model: CompressionModel) -> tuple:
    """Kept between the tasks of a Python worker; a new model replaces the old one."""
    key = (hash(model.good), hash(model.bad))
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        _COMPRESSORS[key] = model.compressors()
    return _COMPRESSORS[key]


def score_quality(docs: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, higher: good likelier) and ``predicted``."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries and two numbers

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = held.value
        good, bad = _compressors(known)
        for texts in batches:
            x = np.array([feature(t, good, bad) for t in texts], float)
            z = np.clip(known.slope * x + known.offset, -700, 700)
            yield pd.Series(1 / (1 + np.exp(-z)))

    return docs.withColumns({"held_out": is_held_out(FOLDS, FOLD), "score": scored(text_of())}).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
