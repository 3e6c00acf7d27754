"""Connected components of large edge tables, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.runtime import save


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id that edges (a, b) reach from each id, itself included.

    In a round every id points to its least neighbour, the pointers are followed
    to their ends in jumps of doubling length, and the edges are contracted to
    those ends: what is left are the edges between different trees, so rounds
    shrink quickly and stars are done in one.  All tables are written, so joins
    shuffle both sides and the rows of a hub can be split.
    """
    links = save(edges.select("a", "b").filter("a <> b").distinct(), "links")
    labels = links.select(F.col("a").alias("id"), F.col("b").alias("label")).limit(0)
    first = True
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("_least"))
        ends = _ends(save(least.select(F.col("a").alias("id"), F.least("a", "_least").alias("label")), "hooked"))
        if first:
            labels, first = ends, False
        else:
            above = ends.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
            moved = labels.join(above, F.col("label") == F.col("_id"), "left")
            labels = save(moved.select("id", F.coalesce("_label", "label").alias("label")), "labels")
        near = links.join(ends.select(F.col("id").alias("a"), F.col("label").alias("_a")), "a")
        far = near.join(ends.select(F.col("id").alias("b"), F.col("label").alias("_b")), "b")
        links = save(far.select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct(), "links")
    return labels


def _ends(pointers: DataFrame) -> DataFrame:
    """(id, label) with every label followed to the id that points to itself."""
    while True:
        above = pointers.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
        jumped = pointers.join(above, F.col("label") == F.col("_id")).select(
            "id", F.col("_label").alias("label"), (F.col("_label") != F.col("label")).alias("_moved")
        )
        jumped = save(jumped, "jumped")
        pointers = jumped.select("id", "label")
        if jumped.filter("_moved").isEmpty():
            return pointers
