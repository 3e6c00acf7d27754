"""Packing by optimal length buckets and token-budget batches.

The histogram of lengths over the whole table is the only thing gathered: one
row per length that occurs, so never more rows than the longest text has tokens.
Dynamic programming over it chooses the bucket boundaries that minimise the
padding; within a bucket, batches are filled in id order up to the token budget.

No text is dropped, cut or split: the last boundary is the greatest length, and
a text longer than the budget is a batch of its own.

Defined results: a null length counts as zero; ties are broken by the other
columns, then rows that are equal in all of them are interchangeable; an empty
table gives an empty table; input columns that share a name with an output
column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.operators.skew import with_positions
from veilgraph.runtime import save

BUCKETS = 16
TOKEN_BUDGET = 16_384
ADDED = ("n_tokens", "bucket", "bucket_length", "batch", "place", "padding")


@dataclass(frozen=True)
class Buckets:
    """Boundaries in ascending order; a text goes to the first that is not below its length."""

    lengths: tuple[int, ...]
    padding: int


def optimal_buckets(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> Buckets:
    """Boundaries out of ``lengths`` (ascending) that minimise the padding of ``counts`` texts each.

    With k buckets the cost of the lengths up to the j-th is the least over i of
    cost(k - 1, i) + padding of i + 1 .. j up to length j.  In j the candidates
    are lines of falling slope, queried at rising lengths, so a convex hull
    answers all j in one sweep: O(buckets * lengths).
    """
    if not len(lengths):
        return Buckets((), 0)
    if any(b <= a for a, b in zip(lengths, lengths[1:])):
        raise ValueError("lengths must ascend")
    size = [int(x) for x in lengths]
    n = len(size)
    texts, tokens = [0], [0]  # exact integers: sums of large tables pass 2**53
    for length, count in zip(size, counts):
        texts.append(texts[-1] + int(count))
        tokens.append(tokens[-1] + int(count) * length)
    buckets = min(buckets, n)
    cost = [size[j] * texts[j + 1] - tokens[j + 1] for j in range(n)]
    came = [np.full(n, -1, np.int64)]
    for _ in range(1, buckets):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, last length of the earlier buckets
        head, best, frm = 0, list(cost), np.full(n, -1, np.int64)
        for j in range(n):
            if j:
                i = j - 1
                line = (-texts[i + 1], cost[i] + tokens[i + 1], i)
                while len(hull) - head >= 2 and _useless(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            while len(hull) - head >= 2 and _at(hull[head + 1], size[j]) <= _at(hull[head], size[j]):
                head += 1
            if len(hull) > head:
                value = _at(hull[head], size[j]) + size[j] * texts[j + 1] - tokens[j + 1]
                if value < best[j]:
                    best[j], frm[j] = value, hull[head][2]
        if best == cost:
            break
        cost = best
        came.append(frm)
    chosen, j = [], n - 1
    for layer in reversed(came):
        # -1: no earlier bucket is worth it at this number of buckets.
        if j < 0:
            break
        if layer[j] >= 0:
            chosen.append(size[j])
            j = int(layer[j])
        elif layer is came[0]:
            chosen.append(size[j])
            j = -1
    return Buckets(tuple(reversed(chosen)), int(cost[n - 1]))


def _at(line: tuple[int, int, int], x: int) -> int:
    return line[0] * x + line[1]


def _useless(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether ``b`` is nowhere below both ``a`` and ``c`` (slopes fall from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def bucket_index(length: Column, found: Buckets) -> Column:
    """Number of boundaries below the length: a sum of comparisons, no join."""
    index = F.lit(0)
    for boundary in found.lengths[:-1]:
        index = index + (length > boundary).cast("int")
    return index


def pack(
    docs: DataFrame, length: Column, key: str = "doc_id", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET
) -> DataFrame:
    """Each row's bucket, batch and place in the batch; ``docs`` keeps only the columns it comes with.

    ``n_tokens`` is the length; ``bucket_length`` the length of the padded rows of its bucket;
    ``batch`` counts the batches of all buckets from 0; rows times ``bucket_length`` of a
    batch stay within ``budget`` unless it has a single row; ``padding`` is bucket_length - n_tokens.
    """
    others = [c for c in docs.columns if c not in ADDED]
    tokens = F.coalesce(length.cast("bigint"), F.lit(0).cast("bigint")).alias("n_tokens")
    sized = save(docs.select(*[F.col(f"`{c}`") for c in others], tokens), "sized")
    counted = sized.groupBy("n_tokens").agg(F.count("*").alias("n"))
    # One row per length: the most that can come is the number of tokens of the longest text.
    histogram = sorted((r["n_tokens"], r["n"]) for r in counted.collect())
    found = optimal_buckets([t for t, _ in histogram], [n for _, n in histogram], buckets)
    lengths = found.lengths or (0,)
    index = bucket_index(F.col("n_tokens"), found)
    placed = sized.withColumn("bucket", index)
    order = [key, *[c for c in others if c != key]]
    placed = with_positions(placed, order, within=["bucket"], name="_pos")
    reach = F.array(*[F.lit(n).cast("bigint") for n in lengths])[F.col("bucket")]
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(reach, F.lit(1)))).cast("bigint")
    first, firsts, at = 0, [], 0
    for boundary in lengths:
        firsts.append(first)
        rows = 0
        while at < len(histogram) and histogram[at][0] <= boundary:
            rows += histogram[at][1]
            at += 1
        first += -(-rows // max(1, budget // max(1, boundary)))
    start = F.array(*[F.lit(n).cast("bigint") for n in firsts])[F.col("bucket")]
    return placed.select(
        *[F.col(f"`{c}`") for c in others],
        "n_tokens",
        "bucket",
        reach.alias("bucket_length"),
        (start + F.floor(F.col("_pos") / room)).cast("bigint").alias("batch"),
        F.pmod(F.col("_pos"), room).cast("bigint").alias("place"),
        (reach - F.col("n_tokens")).alias("padding"),
    )
