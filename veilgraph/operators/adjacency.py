"""Neighbour rows and neighbour lists.

A hub may hold a large share of all edges, so a neighbour list is cut into
pieces: the piece of a neighbour follows from its id and the degree of the
owner.  No task ever builds the whole list of a hub, and joins on
(id, piece) are balanced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions.arithmetic import piece_count, spread

# Neighbours per piece, on average: of a stored list, and of the rows joined in a traversal.
LIST_ROWS = 1024
JOIN_ROWS = 65_536


def neighbours(edges: DataFrame, piece_rows: int = JOIN_ROWS) -> DataFrame:
    """Both directions of each edge in one scan: (id, piece, nbr, lbl, nbr_pieces).

    ``edges`` carries the degrees of its endpoints.
    """

    def side(own: str, other: str):
        pieces = piece_count(F.col(f"{own}_degree"), piece_rows)
        return F.struct(
            F.col(own).alias("id"),
            F.pmod(spread(F.col(other)), pieces).alias("piece"),
            F.col(other).alias("nbr"),
            F.col("label").alias("lbl"),
            piece_count(F.col(f"{other}_degree"), piece_rows).alias("nbr_pieces"),
        )

    return edges.select(F.inline(F.array(side("u", "v"), side("v", "u"))))


def owner_pieces(ids: DataFrame, nodes: DataFrame, piece_rows: int = JOIN_ROWS) -> DataFrame:
    """(id, piece) for every distinct asked id that is a node: the join keys of its neighbour rows."""
    known = ids.select("id").distinct().join(nodes.select("id", "degree"), "id")
    count = piece_count(F.col("degree"), piece_rows)
    return known.select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("piece"))


def build_adjacency(edges: DataFrame, list_rows: int = LIST_ROWS, buckets: int | None = None) -> DataFrame:
    """(id, piece, nbrs): sorted neighbour lists, in pieces of about ``list_rows`` entries.

    With ``buckets``, lists come dealt to as many tasks by (id, piece), and what is made of them need not be moved.
    """
    entry = F.struct("nbr", "lbl")
    rows = neighbours(edges, list_rows).select("id", "piece", "nbr", "lbl")
    return (
        (rows.repartition(buckets, "id", "piece") if buckets else rows)
        .groupBy("id", "piece")
        .agg(F.array_sort(F.collect_list(entry)).alias("nbrs"))
    )


def expand_lists(lists: DataFrame, column: str = "nbrs") -> DataFrame:
    """One row per neighbour; the other columns are repeated."""
    kept = [c for c in lists.columns if c != column]
    return lists.select(*kept, F.inline(column))


def smallest_neighbours(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest neighbours per id, as (id, nbr, place).

    The limit on the rank is applied in each task before the shuffle, so a hub
    sends at most ``n`` rows per task.
    """
    order = Window.partitionBy("id").orderBy("nbr")
    return rows.select("id", "nbr").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
