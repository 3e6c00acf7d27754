"""Main text of web pages: boosted trees over DOM elements, decoded along the tree.

Every element gets the log odds that main text lies in it, given that it lies in
its parent, from its depth, its subtree's text and link density, its siblings,
its name and the words of its attributes and of its ancestors'.  Decoding goes
down the tree and asks only below elements that were kept, so no paragraph is
kept in a menu that was dropped, and what the trees would say about the inside
of a dropped part is never asked.  They are trained in the same way: on the
elements whose parent holds main text.

The model is trained on the driver from a fixed number of made-up pages
(``html_pages``), as no table says what main text is; its size does not depend
on the data.  Extraction is one narrow pass, page by page.

Defined results: a null or empty html, and a page without main text, have the
empty text; markup that never ends is closed at the end of the page; repeated
rows are extracted each; input columns that share a name with an output column
are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.llm.base import small_batches, text_of
from veilgraph.llm.boosted_trees import Boosted, fit
from veilgraph.llm.dom import Page, blocks, read_page
from veilgraph.llm.html_pages import training_pages

TAGS = (
    "html body head div section article main header footer nav aside form p h1 h2 h3 h4 ul ol li blockquote pre table "
    "tr td figure figcaption span a label dl address"
).split()
FLAGS = "article main nav header footer aside form ul".split()
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody tr td th figure figcaption".split())
SIDE_TAGS = frozenset("nav header footer aside form label address head".split())
MAX_TOKENS = 90
DOUBT = -2.0
SLICE = 8192
_TAG_CODE = {t: i for i, t in enumerate(TAGS)}


@dataclass(frozen=True)
class ExtractionModel:
    trees: Boosted
    tokens: dict[str, int]  # attribute words that the trees may ask for


@dataclass(frozen=True)
class Features:
    """What the trees may ask of each element; words and flags as bits, which only ``rows`` spreads out."""

    general: np.ndarray
    tag: np.ndarray
    flags: np.ndarray  # of the elements above
    words: np.ndarray  # two numbers of 64 bits each
    words_above: np.ndarray
    n_tokens: int
    below: np.ndarray  # characters below each element

    def rows(self, first: int, end: int) -> np.ndarray:
        def spread(bits: np.ndarray, size: int) -> np.ndarray:
            some = bits[first:end]
            return (some[:, np.arange(size) // 64] >> np.arange(size, dtype=np.uint64) % np.uint64(64)) & np.uint64(1)

        names = np.arange(len(TAGS) + 1) == self.tag[first:end, None]
        parts = [spread(self.flags, len(FLAGS)), spread(self.words, self.n_tokens), spread(self.words_above, self.n_tokens)]
        return np.concatenate([self.general[first:end], names, *parts], axis=1)

    def __len__(self) -> int:
        return len(self.tag)


def features(page: Page, tokens: dict[str, int]) -> Features:
    """What is asked of the elements of a page; at most 128 ``tokens``."""
    n = len(page.tag)
    own, links, marks = np.zeros(n), np.zeros(n), np.zeros(n)
    before = np.zeros(n)
    seen, first = 0, np.full(n, -1.0)
    for element, piece, linked in page.runs:
        if first[element] < 0:
            first[element] = seen
        if piece:
            size = len(piece)
            own[element] += size
            seen += size
            if linked:
                links[element] += size
            marks[element] += piece.count(".") + piece.count(",")
    parent = page.parent
    below, below_links, below_marks, below_tags = own.copy(), links.copy(), marks.copy(), np.ones(n)
    children, same = np.zeros(n), Counter()
    place = np.zeros(n)
    for i in range(n - 1, 0, -1):
        up = parent[i]
        below[up] += below[i]
        below_links[up] += below_links[i]
        below_marks[up] += below_marks[i]
        below_tags[up] += below_tags[i]
        if 0 <= first[i] and (first[up] < 0 or first[i] < first[up]):
            first[up] = first[i]
    for i in range(1, n):
        place[i] = children[parent[i]]
        children[parent[i]] += 1
        same[parent[i], page.tag[i]] += 1
    up = np.array([max(p, 0) for p in parent])
    siblings = np.maximum(children[up], 1)
    alike = np.array([1.0] + [same[parent[i], page.tag[i]] for i in range(1, n)])
    whole = max(1.0, below[0])
    before = np.maximum(first, 0)
    spare = np.maximum(siblings - 1, 1)
    others = np.maximum(below[up] - own[up] - below, 0) / spare
    link_share = below_links / (below + 1)
    general = np.stack(
        [
            np.array(page.depth, float),
            np.log1p(own),
            np.log1p(below),
            below / whole,
            link_share,
            np.log1p(below / below_tags),
            below_marks / (below + 1),
            place / siblings,
            np.log1p(siblings),
            alike / siblings,
            np.log1p(others),
            np.log((below + 1) / (others + 1)),
            np.log1p(children),
            before / whole,
            below[up] / whole,
            link_share[up],
            np.array(page.inline, float),
            np.array([1.0 if t in TEXT_TAGS else 2.0 if t in SIDE_TAGS else 0.0 for t in page.tag]),
            np.array([float(len(words)) for words in page.tokens]),
        ],
        axis=1,
    )
    tag = np.array([_TAG_CODE.get(t, len(TAGS)) for t in page.tag])
    own_flag = [1 << FLAGS.index(t) if t in FLAGS else 0 for t in page.tag]
    own_words = [_word_bits(words, tokens) for words in page.tokens]
    flags, above = [0] * n, [0] * n
    for i in range(1, n):
        p = parent[i]
        flags[i] = flags[p] | own_flag[p]
        above[i] = above[p] | own_words[p]
    return Features(general, tag, _halves(flags), _halves(own_words), _halves(above), len(tokens), below)


def _word_bits(words: list[str], tokens: dict[str, int]) -> int:
    bits = 0
    for word in words:
        if word in tokens:
            bits |= 1 << tokens[word]
    return bits


def _halves(bits: list[int]) -> np.ndarray:
    low = (1 << 64) - 1
    return np.array([[b & low, b >> 64] for b in bits], np.uint64)


def margins(pages: list[Features], trees: Boosted) -> np.ndarray:
    """Log odds of the elements of the pages, worked out for a bounded number at once."""
    out, held, size = [], [], 0
    for found in pages:
        for first in range(0, len(found), SLICE):
            held.append(found.rows(first, min(len(found), first + SLICE)))
            size += len(held[-1])
            if size >= SLICE:
                out.append(trees.margin(np.concatenate(held)))
                held, size = [], 0
    if held:
        out.append(trees.margin(np.concatenate(held)))
    return np.concatenate(out)


@cache
def trained_model() -> ExtractionModel:
    """The model of the made-up pages; the same in every process."""
    pages = [(read_page(source), labels) for source, labels in training_pages()]
    for page, labels in pages:
        if len(page.tag) != len(labels):
            raise ValueError("a training page was read differently from how it was made")
    counts = Counter(w for page, _ in pages for words in page.tokens for w in set(words))
    tokens = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:MAX_TOKENS])}
    made = [features(page, tokens) for page, _ in pages]
    x = np.concatenate([f.rows(0, len(f)) for f in made])
    y = np.array([label for _, labels in pages for label in labels], float)
    weight = np.concatenate([1 + np.log1p(f.below) / 4 for f in made])
    asked = np.array([i == 0 or labels[p.parent[i]] for p, labels in pages for i in range(len(labels))])
    return ExtractionModel(fit(x[asked], y[asked], weight[asked]), tokens)


def keep(page: Page, margin: np.ndarray) -> list[bool]:
    """From the root down: an element is kept if its parent is and its own odds are for it.

    Where that leaves no text, the likeliest element below a kept one is kept
    after all, unless its odds are below DOUBT.
    """
    odds = margin.copy()
    odds[0] = np.inf
    with_text = {element for element, piece, _ in page.runs if piece and not piece.isspace()}
    while True:
        kept = [True] * len(odds)
        doubtful = []
        for i in range(1, len(odds)):
            kept[i] = kept[page.parent[i]] and bool(odds[i] > 0)
            if not kept[i] and kept[page.parent[i]] and odds[i] > DOUBT:
                doubtful.append(i)
        if not doubtful or any(kept[i] for i in with_text):
            return kept
        odds[max(doubtful, key=lambda i: odds[i])] = np.inf


def extract(sources: list[str], model: ExtractionModel) -> list[str]:
    """Main text of each page; the trees see all elements of the pages at once."""
    pages = [read_page(s) for s in sources]
    if not pages:
        return []
    margin = margins([features(p, model.tokens) for p in pages], model.trees)
    out, at = [], 0
    for page in pages:
        n = len(page.tag)
        out.append("\n".join(blocks(page, keep(page, margin[at : at + n]))))
        at += n
    return out


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without ``column``, with ``text`` and ``n_chars`` (its code points)."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained_model())  # a fixed number of trees

    @F.pandas_udf(T.StringType())
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for sources in batches:
            out: list[str] = []
            group: list[str] = []
            size = 0
            for source in sources:  # a bounded number of characters at once
                group.append(source)
                size += len(source)
                if size > 500_000:
                    out += extract(group, model)
                    group, size = [], 0
            yield pd.Series(out + extract(group, model), dtype=object)

    others = [F.col(f"`{c}`") for c in pages.columns if c not in (column, "text", "n_chars")]
    found = pages.select(*others, extracted(text_of(column)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
