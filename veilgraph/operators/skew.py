"""Operators that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.runtime import save

# A key with more rows than this is a hub and is not shuffled to one task ...
HUB_ROWS = 100_000
# ... and there are never more hubs than this, so the hub table may be broadcast:
# the bound on rows per key rises with the data instead (see ``hub_bound``).
MAX_HUBS = 50_000
# A side within this size, and of at most MAX_HUBS rows, is broadcast.
BROADCAST_BYTES = 64 << 20
REPEAT_BLOCK = 65_536


def hub_bound(total_rows: int, hub_rows: int | None = None) -> int:
    """Rows per key above which a key is a hub; at most MAX_HUBS keys can exceed it."""
    return max(HUB_ROWS if hub_rows is None else hub_rows, ceil(total_rows / max(1, MAX_HUBS)))


@dataclass(frozen=True)
class Dimension:
    """A table with one row per key, and its hub rows (None when there are none)."""

    rows: DataFrame
    key: str
    hubs: DataFrame | None

    @staticmethod
    def of(rows: DataFrame, key: str, weight: str, hub_rows: int | None = None) -> "Dimension":
        """``weight`` is the number of rows that will look up the key."""
        top, total = rows.agg(F.max(weight), F.sum(weight)).first()
        bound = hub_bound(total or 0, hub_rows)
        hubs = rows.filter(F.col(weight) > bound) if (top or 0) > bound else None
        return Dimension(rows, key, hubs)


def attach(rows: DataFrame, key: str, dim: Dimension, columns: dict[str, str], scatter: Column) -> DataFrame:
    """Left-join ``columns`` (source -> target name) of ``dim`` to ``rows`` on ``key``.

    Hub keys get their columns from the broadcast hub table (at most MAX_HUBS
    rows); for the shuffle join their rows carry ``scatter`` in place of the key
    and so spread over all tasks.
    """
    targets = list(columns.values())
    values = [F.col(src).alias(dst) for src, dst in columns.items()]
    plain = dim.rows.select(F.col(dim.key).alias("_dim_key"), *values)
    if dim.hubs is None:
        return rows.join(plain, F.col(key) == F.col("_dim_key"), "left").drop("_dim_key")
    hubs = dim.hubs.select(
        F.col(dim.key).alias("_hub_key"), *[F.col(src).alias(f"_hub_{dst}") for src, dst in columns.items()]
    )
    tagged = rows.join(F.broadcast(hubs), F.col(key) == F.col("_hub_key"), "left")
    is_hub = F.col("_hub_key").isNotNull()
    keyed = tagged.withColumn("_join_key", F.when(is_hub, scatter).otherwise(F.col(key)))
    joined = keyed.join(plain, F.col("_join_key") == F.col("_dim_key"), "left")
    picked = {t: F.when(is_hub, F.col(f"_hub_{t}")).otherwise(F.col(t)) for t in targets}
    return joined.withColumns(picked).drop(
        "_dim_key", "_hub_key", "_join_key", *[f"_hub_{t}" for t in targets]
    )


def join_small(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` to a written table ``side`` with one row per key, or a few.

    ``side`` is broadcast only after its bytes and its rows were counted.  With a longer one, keys that more than
    ``hub_bound`` of the ``rows`` have are found by a count that is combined before its shuffle; their rows, and
    theirs alone, meet the broadcast part of the side that names them (at most MAX_HUBS rows).
    """
    if written_bytes(side) <= BROADCAST_BYTES and side.count() <= MAX_HUBS:
        return rows.join(F.broadcast(side), on, how)
    weights = save(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), "key-weights")
    total, top = weights.agg(F.sum("_n"), F.max("_n")).first()
    bound = hub_bound(total or 0)
    if (top or 0) <= bound:
        return rows.join(side, on, how)
    hot = weights.filter(F.col("_n") > bound).select(*on)  # at most MAX_HUBS rows
    hot_rows = rows.join(F.broadcast(hot), on, "left_semi")
    hot_side = side.join(F.broadcast(hot), on, "left_semi")
    others = rows.join(F.broadcast(hot), on, "left_anti")
    return others.join(side, on, how).unionByName(hot_rows.join(F.broadcast(hot_side), on, how))


def written_bytes(table: DataFrame) -> int:
    """The size the planner knows: that of the files, for a written table."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def filter_by_keys(rows: DataFrame, key: str, wanted: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose ``key`` is (or, with ``keep=False``, is not) in ``wanted`` (one column, distinct, written)."""
    return join_small(rows, wanted, [key], "left_semi" if keep else "left_anti")


def with_positions(
    df: DataFrame, order: list, within: list[str] = (), name: str = "pos", size: str | None = None
) -> DataFrame:
    """Dense 0-based position by ``order`` (per ``within`` group) without a one-task window.

    Rows are range-partitioned on (group, order) and written with their place in
    their partition.  The offset of each partition comes from a table with one
    row per (group, partition); even a single group that holds most of the
    rows is spread over many partitions.  ``order`` must be a total order.
    """
    groups = list(within)
    keys = [F.col(g) for g in groups] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = save(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id()),
        f"ranged-{name}",
    ).withColumn("_part", F.shiftright("_place", 33))
    runs = placed.groupBy(*groups, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if size:
        offsets = offsets.withColumn(size, F.sum("_rows").over(Window.partitionBy(*groups)))
    # One row per range partition, and one more per further group in it.
    offsets = save(offsets.drop("_rows"), f"offsets-{name}")
    return (
        join_small(placed, offsets, [*groups, "_part"])
        .withColumn(name, F.col("_before") + F.col("_place") - F.col("_first"))
        .drop("_place", "_part", "_first", "_before")
    )


def repeat_rows(
    df: DataFrame, times: Column, keys: list[str], index: str = "i", written: bool = False
) -> DataFrame:
    """Emit each row ``times`` times, numbered from 0.

    A row is first cut into blocks of copies and the blocks are redistributed,
    so one row with an enormous count is not expanded by a single task.  Of a
    ``written`` table, which is cheap to read twice, only rows of several
    blocks are moved.
    """
    counted = df.withColumn("_times", times.cast("bigint")).filter(F.col("_times") > 0)

    def cut(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_times - 1) div {REPEAT_BLOCK})")))

    if written:
        long = cut(counted.filter(F.col("_times") > REPEAT_BLOCK)).repartition(*keys, "_block")
        blocks = counted.filter(F.col("_times") <= REPEAT_BLOCK).withColumn("_block", F.lit(0).cast("bigint"))
        blocks = blocks.unionByName(long)
    else:
        blocks = cut(counted).repartition(*keys, "_block")
    first = F.col("_block") * REPEAT_BLOCK
    last = F.least(F.col("_times"), first + REPEAT_BLOCK) - 1
    return blocks.withColumn(index, F.explode(F.sequence(first, last))).drop("_times", "_block")
