"""Bounded, repeatable samples of labelled texts, and the rows a classifier must not learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.llm.base import text_of


def remainder(folds: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``folds``; an id of null has none."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def is_held_out(folds: int, fold: int, key: str = "doc_id") -> Column:
    return F.coalesce(remainder(folds, key) == fold, F.lit(False))


def least_hashed(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """The ``size`` rows whose keys have the least hash, in that order.

    A first cut by the hash, from the number of rows, leaves about four times
    as many, so that what the tasks sort and send does not grow with the table.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    share = min(1.0, 4 * size / max(1, rows.count()))
    near = rows if share == 1.0 else rows.filter(place <= int(share * (1 << 40)))
    return near.orderBy(place, *keys).limit(size)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int, max_chars: int
) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Up to ``per_class`` texts of each label, none held out, and the number of labelled rows of each label.

    The rows are those with the least hash of their id, so that the sample is
    the same in every run.  The driver gets at most ``2 * per_class`` texts, cut
    to ``max_chars`` characters.  An id with several labels counts with the least, one with several texts with
    the least of them.
    """
    usable = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(folds, fold))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("_label"))
    )
    counts = {r["_label"]: r["n"] for r in usable.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value in (0, 1):
        some = least_hashed(usable.filter(F.col("_label") == value), per_class, "doc_id")
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select("doc_id", F.substring(text_of(), 1, max_chars).alias("_text"))
    # At most 2 * per_class ids are broadcast.
    single = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.min("_text").alias("_text"))
    rows = single.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [(r["_text"], r["_label"]) for r in rows], counts
