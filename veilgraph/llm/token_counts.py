"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with failure links: where a word leaves the trie, the
link of the state says how many pieces are thereby complete and in which state
matching goes on.  Those numbers are worked out once, so counting reads each
character once and builds no piece.  A word that cannot be covered counts as
one unknown piece.

The automaton has the size of the vocabulary and is built once in a Python
worker.  Counts of distinct short words are kept in a bounded table.  A text's
count is the sum over its words; no shuffle.

Defined results: a null or empty text has no words and no pieces; repeated rows
are counted each; input columns that share a name with an output column are
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.llm.base import small_batches, text_of

MARKER = "▁"
MAX_TABLE_WORDS = 500_000
# A run of word characters is a word, any other visible character one of its own.
WORD = re.compile(r"\w+|[^\w\s]")


def piece_vocabulary(model_path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that go on, from a SentencePiece model.

    Marked pieces begin a word; single characters may as well.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    initial, following = set(), set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith(MARKER):
            initial.add(piece.lstrip(MARKER))
        else:
            following.add(piece)
            if len(piece) == 1:
                initial.add(piece)
    return sorted(initial - {""}), sorted(following)


class PieceCounter(dict):
    """Number of pieces of a word (0: the word is unknown), with the automaton behind it."""

    def __init__(self, initial: Iterable[str], following: Iterable[str]):
        super().__init__()
        # States 0 and 1 are the roots: at a word's begin, and after a piece.
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, initial), (1, following)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    at = self.next[at][c]
                ends[at] = at > 1
        self.link = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [0, 1]
        while level:
            deeper = []
            for u in level:
                for c, v in self.next[u].items():
                    deeper.append(v)
                    if ends[v]:
                        self.link[v], self.popped[v] = 1, 1
                        continue
                    count, z = self.popped[u], self.link[u]
                    while z >= 0 and c not in self.next[z]:
                        count += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.next[z][c], count
            level = deeper

    def count(self, word: str) -> int:
        at = total = 0
        for c in word:
            while c not in self.next[at]:
                if self.link[at] < 0:
                    return 0
                total += self.popped[at]
                at = self.link[at]
            at = self.next[at][c]
        while at != 1:
            if self.link[at] < 0:
                return 0
            total += self.popped[at]
            at = self.link[at]
        return total

    def __missing__(self, word: str) -> int:
        found = self.count(word)
        if len(word) <= 64:
            if len(self) >= MAX_TABLE_WORDS:
                self.clear()
            self[word] = found
        return found


_COUNTERS: dict[str, PieceCounter] = {}


def _counter(model_path: str) -> PieceCounter:
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = PieceCounter(*piece_vocabulary(model_path))
    return _COUNTERS[model_path]


def token_counts(docs: DataFrame, model_path: str, column: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_pieces`` (unknown words count one each) and ``n_unknown``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_pieces", "n_unknown")]))
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = _counter(model_path)
        for texts in batches:
            rows = []
            for text in texts:
                counts = [table[w] for w in WORD.findall(text)]
                unknown = counts.count(0)
                rows.append((len(counts), sum(counts) + unknown, unknown))
            yield pd.DataFrame(rows, columns=["n_words", "n_pieces", "n_unknown"], dtype="int64")

    names = ("n_words", "n_pieces", "n_unknown")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    held = "_counts"
    while held in docs.columns:
        held = f"_{held}"
    return docs.select(*others, counted(text_of(column)).alias(held)).select(*others, f"{held}.*")
