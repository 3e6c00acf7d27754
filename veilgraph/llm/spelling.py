"""Spelling variants: words one edit apart, found by bit-sliced position indexes, grouped under the frequent form.

1. The vocabulary is counted with partial aggregation; only words that are long
   and frequent enough stay.
2. Exact blocks.  An edit touches one place, so two words at distance one share
   all letters before it and all after it.  Pairs of lengths ``size`` and
   ``size`` or ``size + 1`` are looked for in blocks of words that share the
   letters outside an interval of places; the intervals cover all places once.
   At first they are the two halves of a word; an interval whose block has too
   many words is halved again, until it is one place and the block is bounded by
   the alphabet.  No block is cut and no pair is lost.
3. In a block, each (place, letter) has a bit set over the block's words.  One
   sweep over a word's letters tracks, for all words of the block at once, the
   set without an error and the sets with one: aligned after a replaced letter,
   shifted forwards after an inserted one, shifted back after a deleted one.
   An error starts where the set without one ends, so a pair counts in the one
   interval that holds its first difference.
4. A word's near words are added up over its blocks; forms are followed to their
   ends by pointer jumping over the words that have one.

Defined results: a null text has no words; a null id is hashed as empty text;
repeated rows count again; ties of frequency go to the least word in code-point
order; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.llm.base import text_of
from veilgraph.llm.runs import in_frames, runs_of
from veilgraph.runtime import keep, save, scratch

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
DELETE_MODULUS = 31
BLOCK_WORDS = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the letter runs, some with one letter left out, that are long and frequent enough."""
    # Nothing gets longer, so shorter runs can be passed over at once; a run is matched whole or not at all.
    runs = F.regexp_extract_all(text_of(), F.lit(f"[A-Za-zÀ-ÿ]{{{min_length},}}"), 0)
    found = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(runs).alias("found"),
    ).select("id", F.translate("found", _UPPER, _LOWER).alias("run"))
    lot = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(F.col("lot"), F.length("run")).cast("int")
    shorter = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    words = found.withColumn("lot", lot).withColumn("at", at)
    words = words.select(F.when(F.col("lot") % DELETE_MODULUS == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _shared(word: Column) -> Column:
    """The letters outside [lo, hi) of the shorter word: the first ``lo`` and the last ``size - hi``."""
    return F.concat_ws(
        " ", F.substring(word, F.lit(1), F.col("lo")), F.right(word, F.col("size") - F.col("hi"))
    )


def edit_blocks(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, size, lo, hi, shared): each word in the blocks of its intervals; a block of several places is small."""
    length = F.length("word")
    half = F.floor(F.col("size") / 2).cast("int")
    open_blocks = (
        words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size"))
        .withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            "word",
            "n",
            "size",
            F.when(F.col("part") == 0, F.lit(0)).otherwise(half).alias("lo"),
            F.when(F.col("part") == 0, half).otherwise(F.col("size")).alias("hi"),
        )
        .withColumn("shared", _shared(F.col("word")))
    )
    key = ["size", "lo", "hi", "shared"]
    done = None
    while True:
        counts = open_blocks.groupBy(*key).agg(F.count("*").alias("rows"))
        large = save(counts.filter((F.col("rows") > block_words) & (F.col("hi") - F.col("lo") > 1)), "large-blocks")
        if large.isEmpty():
            return open_blocks if done is None else done.unionByName(open_blocks)
        # Both sides of the join are shuffled, so a large block's rows can be split.
        split = save(open_blocks.join(large, key, "left"), "block-rows")
        small = split.filter("rows IS NULL").drop("rows")
        done = small if done is None else done.unionByName(small)
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = (
            split.filter("rows IS NOT NULL")
            .withColumn("middle", middle)
            .withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
        )
        open_blocks = halves.select(
            "word",
            "n",
            "size",
            F.when(F.col("part") == 0, F.col("lo")).otherwise(F.col("middle")).alias("lo"),
            F.when(F.col("part") == 0, F.col("middle")).otherwise(F.col("hi")).alias("hi"),
        ).withColumn("shared", _shared(F.col("word")))


class PositionIndex:
    """Bit sets over the words of a block: bit i stands for the i-th, and ``at[p][c]`` for those with letter c at p."""

    def __init__(self, words: list[str]):
        self.words = words
        self.at: list[dict[str, int]] = []
        self.of_length: dict[int, int] = defaultdict(int)
        places: list[dict[str, list[int]]] = []
        for i, word in enumerate(words):
            while len(places) < len(word):
                places.append(defaultdict(list))
            for p, letter in enumerate(word):
                places[p][letter].append(i)
            self.of_length[len(word)] |= 1 << i
        octets = (len(words) + 7) // 8
        for letters in places:
            sets = {}
            for letter, members in letters.items():
                bits = bytearray(octets)
                for i in members:
                    bits[i >> 3] |= 1 << (i & 7)
                sets[letter] = int.from_bytes(bits, "little")
            self.at.append(sets)
        self.every = (1 << len(words)) - 1

    def _with(self, place: int, letter: str) -> int:
        return self.at[place].get(letter, 0) if 0 <= place < len(self.at) else 0

    def near(self, word: str, last: bool) -> tuple[int, int, int]:
        """Words with one letter replaced, one more and one less than ``word``.

        Without ``last`` the pairs whose first difference is after the shorter one's end are left out.
        """
        exact, aligned, longer, shorter = self.every, 0, 0, 0
        size = len(word)
        for p, letter in enumerate(word):
            here = self._with(p, letter)
            # The sets with an error go on in step, one place ahead, and one place behind.
            aligned &= here
            longer &= self._with(p + 1, letter)
            shorter &= self._with(p - 1, letter)
            broken = exact & ~here  # the first difference is here
            exact &= here
            aligned |= broken
            # This letter comes one place later in a longer word; in a shorter one it is left out.
            longer |= broken & self._with(p + 1, letter)
            shorter |= broken if last or p < size - 1 else 0
        if last:
            longer |= exact
        return (
            aligned & self.of_length.get(size, 0),
            longer & self.of_length.get(size + 1, 0),
            shorter & self.of_length.get(size - 1, 0),
        )


def block_variants(words: list[str], counts: list[int], size: int, lo: int, hi: int) -> list[tuple[str, int, str, int]]:
    """(word, near words, the best of them, its count) for the words of a block that have any in its interval."""
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    behind = size - hi
    middles = [words[i][lo : len(words[i]) - behind] for i in order]
    index = PositionIndex(middles)
    out = []
    for i, middle in zip(order, middles):
        replaced, longer, shorter = index.near(middle, hi == size)
        found = replaced | longer if len(middle) == hi - lo else shorter
        if found:
            best = order[(found & -found).bit_length() - 1]  # by frequency, then word
            out.append((words[i], found.bit_count(), words[best], counts[best]))
    return out


def near_words(blocks: DataFrame) -> DataFrame:
    """(word, near, best, best_n) of each word with near words in a block; a pair is found in one block."""

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for run in runs_of(batches, ["size", "lo", "hi", "shared"], least=2):
            yield from block_variants(run["word"], run["n"], run["size"][0], run["lo"][0], run["hi"][0])

    def swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_frames(rows_of(batches), ["word", "near", "best", "best_n"])

    key = ["size", "lo", "hi", "shared"]
    return (
        blocks.repartition(*key)
        .sortWithinPartitions(*key)
        .mapInPandas(swept, "word string, near bigint, best string, best_n bigint")
    )


def followed(pointers: DataFrame) -> DataFrame:
    """(word, root): ``pointers`` (word, form) followed to the last form; every step leads to a more frequent word."""
    ends = save(pointers.select("word", F.col("form").alias("root")), "forms")
    while True:
        above = ends.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        jumped = ends.join(above, F.col("root") == F.col("_word"), "left")
        moved = F.col("_root").isNotNull()
        jumped = jumped.select("word", F.coalesce("_root", "root").alias("root"), moved.alias("moved"))
        jumped = save(jumped, "jumped-forms")
        ends = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            return ends


def spelling_variants(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary."""
    with scratch(docs.sparkSession):
        words = save(vocabulary(docs, min_length, min_count), "vocabulary")
        found = near_words(edit_blocks(words, block_words))
        best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("top")
        grouped = found.groupBy("word").agg(F.sum("near").alias("n_near"), best)
        joined = words.join(grouped, "word", "left")
        form_n = F.when(-F.col("top.less") >= ratio * F.col("n"), -F.col("top.less"))
        formed = save(
            joined.select(
                "word",
                F.when(form_n.isNotNull(), F.col("top.word")).alias("form"),
                "n",
                F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                form_n.alias("form_n"),
            ),
            "formed",
        )
        roots = followed(formed.filter("form IS NOT NULL"))
        whole = formed.join(roots, "word", "left").select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
        )
        return keep(save(whole, "spelling"))
