"""Substring deduplication: words inside a window that also starts somewhere else are removed.

1. *Name.*  Every text is recompressed (``recompression``), long ones in pieces
   that overlap by a window.  Names of runs and pairs are hashes of what they
   stand for, so all tasks give the same passage the same symbols.  Windows with
   one anchor, the highest symbol in them, make a row: anchor, a hash of all
   their signatures, and where they lie.  That is a row for several words, and
   nothing is sent for a single window.
2. *Reveal.*  Anchors are counted.  Windows of an anchor that occurs once are
   unique.  Where an anchor always has the same signatures, all its windows are
   repeated.
3. *Verify.*  Of the anchors left, one row of each kind is looked at window by
   window; windows whose signature belongs to two kinds, or whose kind occurs
   twice, are repeated.
4. What is repeated goes to its document, as a mask for each row; documents
   with nothing repeated are not moved at all.

An anchor that holds a third of all rows is counted before the shuffle and its
rows are spread in the join.  Signatures and names have 64 bits each, and two
windows count as equal when both agree.

Defined results: a null or empty text has no words; rows that share an id are
documents of their own, also when they are equal in everything; a null id stays
null; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.llm.base import text_of, words_of
from veilgraph.llm.recompression import mix, windows
from veilgraph.operators.skew import Dimension, attach
from veilgraph.runtime import keep, save, scratch

WIDTH = 35
PIECE_WORDS = 32_000
PIECE_BYTES = 1 << 20
HUB_ROWS = 2_000
# A row's place: the first word of its windows, and how many they are (never more than WIDTH).
PLACE_BASE = 1024
# White space in UTF-8, as ``bytes.split`` takes it too: space, and tab to carriage return.
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_OCTETS = np.random.default_rng(13).integers(0, 1 << 64, 256, np.uint64)
# The base of the words' polynomials, and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWER = np.uint64(_BASE)


@lru_cache(4)
def _powers(base: int, size: int) -> np.ndarray:
    found = np.full(size, np.uint64(base))
    found[0] = 1
    return np.cumprod(found, dtype=np.uint64)


def _hashes(octets: np.ndarray) -> np.ndarray:
    """Hashes of the words of a piece, all at once: polynomials of their octets, mixed with their lengths."""
    size = 1 << max(16, len(octets).bit_length())
    inside = np.concatenate([[False], ~_SPACE[octets], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    total = np.zeros(len(octets) + 1, np.uint64)
    np.cumsum(_OCTETS[octets] * _powers(_BASE, size)[: len(octets)], out=total[1:])
    polynomial = (total[end] - total[first]) * _powers(_INVERSE, size)[first]
    return mix(polynomial + (end - first).astype(np.uint64) * _POWER)


def word_hashes(text: str) -> np.ndarray:
    """A hash of 64 bits for each word; long texts are read in pieces that end at white space."""
    octets, at, parts = text.encode(), 0, []
    while at < len(octets):
        gap = _GAP.search(octets, at + PIECE_BYTES)
        end = gap.start() if gap else len(octets)
        parts.append(_hashes(np.frombuffer(octets, np.uint8, end - at, at)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class Pieces:
    """Pieces of several texts, side by side with walls between them, up to about PIECE_WORDS words."""

    def __init__(self, width: int):
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.size = 0
        self.owners: list[tuple[int, int, int, int]] = []  # (owner, first word in its text, begin here, windows)

    def add(self, owner: int, hashes: np.ndarray, first: int, count: int) -> None:
        """The piece of ``hashes`` that holds the ``count`` windows from the word ``first``."""
        piece = hashes[first : first + count + self.width - 1]
        self.owners.append((owner, first, self.size, count))
        self.hashes += [piece, np.zeros(1, np.uint64)]
        self.size += len(piece) + 1

    def windows(self):
        """(owner, first word, place here) of each window, and the windows."""
        words = np.concatenate(self.hashes)
        walls = np.zeros(len(words), bool)
        walls[np.cumsum([len(h) for h in self.hashes])[1::2] - 1] = True
        counts = np.array([o[3] for o in self.owners])
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        owner, first, here = (np.repeat([o[k] for o in self.owners], counts) for k in range(3))
        return owner, first + inner, here + inner, windows(words, walls, here + inner, self.width)


def text_pieces(texts: Iterator[tuple[int, str]], width: int) -> Iterator[Pieces]:
    """All windows of the texts; a piece has a bounded number of them."""
    pieces = Pieces(width)
    for owner, text in texts:
        hashes = word_hashes(text)
        for first in range(0, len(hashes) - width + 1, PIECE_WORDS):
            pieces.add(owner, hashes, first, min(PIECE_WORDS, len(hashes) - width + 1 - first))
            if pieces.size >= PIECE_WORDS:
                yield pieces
                pieces.clear()
    if pieces.size:
        yield pieces


def anchor_rows(texts: Iterator[tuple[int, str]], width: int) -> Iterator[pd.DataFrame]:
    """(anchor, context, doc, place): windows that follow each other and have one anchor are one row."""
    for pieces in text_pieces(texts, width):
        owner, first, here, found = pieces.windows()
        head = np.ones(len(first), bool)
        head[1:] = (found.place[1:] != found.place[:-1]) | (found.anchor[1:] != found.anchor[:-1])
        head[1:] |= (owner[1:] != owner[:-1]) | (first[1:] != first[:-1] + 1)
        begins = np.flatnonzero(head)
        counts = np.diff(np.append(begins, len(first)))
        inner = np.arange(len(first)) - np.repeat(begins, counts)
        power = np.cumprod(np.full(int(counts.max()) + 1, _POWER), dtype=np.uint64)
        context = np.add.reduceat(mix(found.signature) * power[inner], begins)
        offset = (found.place - here)[begins].astype(np.uint64)
        context = mix(context + counts.astype(np.uint64) * _POWER + offset)
        yield pd.DataFrame(
            {
                "anchor": found.anchor[begins].view(np.int64),
                "context": context.view(np.int64),
                "doc": owner[begins],
                "place": first[begins] * PLACE_BASE + counts,
            }
        )


def row_key() -> Column:
    """Names a row by its id and text; rows equal in both have the same windows."""
    return F.xxhash64("doc_id", "text")


def _keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", row_key().alias("doc"))


def window_rows(docs: DataFrame, width: int) -> DataFrame:
    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from anchor_rows(zip(batch["doc"], batch["text"]), width)

    # A text of ``width`` words has as many characters and the gaps between them.
    texts = _keyed_texts(docs).filter(F.length("text") >= 2 * width - 1).select("doc", "text")
    return texts.mapInPandas(described, "anchor bigint, context bigint, doc bigint, place bigint")


def _spread(rows: DataFrame, side: DataFrame, weight: str, key: list[str], columns: list[str]) -> DataFrame:
    """``rows`` joined to ``side`` (one row per key); rows of hot keys are spread."""
    pair = F.struct(*key)
    dim = Dimension.of(side.withColumn("_key", pair), "_key", weight, HUB_ROWS)
    scatter = F.struct(
        F.xxhash64("doc", "place").alias(key[0]), *[F.lit(None).cast("bigint").alias(k) for k in key[1:]]
    )
    joined = attach(rows.withColumn("_own", pair), "_own", dim, {c: f"_{c}" for c in columns}, scatter)
    return joined.drop("_own").withColumnsRenamed({f"_{c}": c for c in columns})


def repeated_masks(docs: DataFrame, width: int) -> DataFrame:
    """(doc, place, mask): bit i tells that the i-th window from the place starts elsewhere too."""
    rows = save(window_rows(docs, width), "window-rows")
    every = F.lit(-1).cast("bigint")
    shared = rows.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")
    )
    shared = save(shared.filter("n > 1"), "shared-anchors")
    found = _spread(rows, shared, "n", ["anchor"], ["n", "low", "high"]).filter("n > 1")
    found = save(found.withColumn("sure", F.col("low") == F.col("high")).drop("n", "low", "high"), "revealed")
    open_rows = found.filter("NOT sure").drop("sure")
    kinds = open_rows.groupBy("anchor", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("doc", "place")).alias("one")
    )
    kinds = save(kinds.select("anchor", "context", "n", "one.doc", "one.place"), "kinds")
    masks = kinds.join(verified(docs, kinds, width), ["anchor", "context"], "left").select(
        "anchor", "context", "n", F.when(F.col("n") > 1, every).otherwise(F.col("mask")).alias("mask")
    )
    masks = save(masks.filter("mask IS NOT NULL"), "masks")
    opened = _spread(open_rows, masks, "n", ["anchor", "context"], ["mask"]).filter("mask IS NOT NULL")
    sure = found.filter("sure").select("doc", "place", every.alias("mask"))
    return sure.unionByName(opened.select("doc", "place", "mask"))


def verified(docs: DataFrame, kinds: DataFrame, width: int) -> DataFrame:
    """(anchor, context, mask): the windows of each kind whose signature another kind of its anchor has too."""
    asked = kinds.groupBy("doc").agg(F.collect_list(F.struct("anchor", "context", "place")).alias("asked"))
    texts = _keyed_texts(docs).join(asked, "doc").select("doc", "text", "asked")

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = (row for batch in batches for row in zip(batch["doc"], batch["text"], batch["asked"]))
        return window_signatures(texts, width)

    signed_as = "anchor bigint, context bigint, i int, signature bigint, doc bigint, place bigint"
    each = save(texts.mapInPandas(signed, signed_as), "signed-windows")
    # A signature belongs to one window of a row, so it is in another kind where it has two contexts; rows that
    # are equal in everything share a text and give the same window twice.
    twice = each.groupBy("anchor", "signature").agg(
        F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")
    )
    twice = save(twice.filter("low < high").drop("low", "high"), "shared-signatures")
    again = _spread(each, twice, "n", ["anchor", "signature"], ["n"]).filter("n > 1")
    return again.groupBy("anchor", "context").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))


def window_signatures(texts: Iterator[tuple], width: int) -> Iterator[pd.DataFrame]:
    """(anchor, context, i, signature, doc, place) of every window of the rows asked of each (doc, text, asked)."""
    pieces = Pieces(width)
    rows: list[tuple[int, int, int, int]] = []

    def signed() -> pd.DataFrame:
        owner, first, _, found = pieces.windows()
        anchor, context, place, doc = (np.array(values)[owner] for values in zip(*rows))
        i = (first - place // PLACE_BASE).astype(np.int32)
        signature = found.signature.view(np.int64)
        return pd.DataFrame(
            {"anchor": anchor, "context": context, "i": i, "signature": signature, "doc": doc, "place": place}
        )

    for doc, text, asked in texts:
        hashes = word_hashes(text)
        for row in asked:
            pieces.add(len(rows), hashes, row["place"] // PLACE_BASE, row["place"] % PLACE_BASE)
            rows.append((row["anchor"], row["context"], row["place"], doc))
            if pieces.size >= PIECE_WORDS:
                yield signed()
                pieces.clear()
                rows = []
    if rows:
        yield signed()


def removed_words(n_words: int, marks, width: int) -> np.ndarray:
    """Whether each word is in a repeated window; ``marks`` are the (place, mask) of a text."""
    starts = np.zeros(n_words, bool)
    for mark in marks:
        first, count = divmod(mark["place"], PLACE_BASE)
        if mark["mask"] == -1:
            starts[first : first + count] = True
        else:
            for i in range(count):
                if mark["mask"] >> i & 1:
                    starts[first + i] = True
    edges = np.zeros(n_words + 1, np.int64)
    edges[np.flatnonzero(starts)] += 1
    edges[np.flatnonzero(starts) + width] -= 1
    return np.cumsum(edges)[:-1] > 0


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row: words left after repeated windows are removed."""
    id_type = docs.schema["doc_id"].dataType
    with scratch(docs.sparkSession):
        marks = repeated_masks(docs, width)
        # A set: rows that are equal in everything give the same marks.
        marks = save(marks.groupBy("doc").agg(F.collect_set(F.struct("place", "mask")).alias("marks")), "marks")
        words = words_of(text_of())
        untouched = _keyed_texts(docs).select(
            "doc_id",
            "doc",
            F.size(words).cast("bigint").alias("n_words"),
            F.lit(0).cast("bigint").alias("n_removed"),
            F.sha2(F.concat_ws(" ", words), 256).alias("kept_sha256"),
        )
        untouched = untouched.join(marks.select("doc"), "doc", "left_anti").drop("doc")

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for doc_id, text, marks in zip(batch["doc_id"], batch["text"], batch["marks"]):
                    words = text.encode().split()
                    gone = removed_words(len(words), marks, width)
                    kept = b" ".join(compress(words, (~gone).tolist()))
                    rows.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
                yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

        touched = _keyed_texts(docs).join(marks, "doc")
        touched = touched.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "marks").mapInPandas(
            cut, "doc_id string, n_words bigint, n_removed bigint, kept_sha256 string"
        )
        whole = untouched.unionByName(touched.withColumn("doc_id", F.col("doc_id").cast(id_type)))
        return keep(save(whole, "substring-dedup"))
