"""Breadth-first traversal from many starts at once.

A start is one bit of a 62-bit mask, so a node reached from many starts is one
row per level and block of starts, not one row per start.  A level is one
balanced join on (id, piece) and one aggregation that combines masks before
the shuffle; the neighbour table is bucketed once for all levels.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions.arithmetic import doubled_size, padded_size, piece_count, shard_size
from veilgraph.functions.crypto import Keys
from veilgraph.operators.adjacency import JOIN_ROWS, neighbours
from veilgraph.operators.graph import Graph
from veilgraph.operators.lookup import (
    exclude_visited,
    fetch_lists,
    lookup_padded,
    requested_pieces,
    restrict_to_frontier,
)
from veilgraph.operators.padding import decoy_copies, pad_table
from veilgraph.operators.protect import Store, open_lists
from veilgraph.operators.skew import with_positions
from veilgraph.runtime import keep, save, save_bucketed, scratch

BITS = 62
DEPTH_CAP = 3
PAIR_HOPS = 4
BUCKET_ROWS = 4_000_000


@dataclass(frozen=True)
class NeighbourTable:
    """rows (id, piece, nbr, nbr_pieces) bucketed on (id, piece), and the rows per piece."""

    rows: DataFrame
    piece_rows: int


def neighbour_table(graph: Graph, piece_rows: int = JOIN_ROWS) -> NeighbourTable:
    rows = neighbours(graph.edges, piece_rows).select("id", "piece", "nbr", "nbr_pieces")
    total = 2 * graph.edges.count()
    default = int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(default, ceil(total / BUCKET_ROWS))
    return NeighbourTable(save_bucketed(rows, "neighbours", buckets, "id", "piece"), piece_rows)


@dataclass(frozen=True)
class Reached:
    """seeds (seed, block, bit); levels (depth, node, block, mask), depth 0 being the starts."""

    seeds: DataFrame
    levels: DataFrame
    bits: int


def reach(seeds: DataFrame, nodes: DataFrame, table: NeighbourTable, max_depth: int) -> Reached:
    """Distances up to ``max_depth`` from every ``seed``; starts that are no nodes reach nothing."""
    numbered = with_positions(save(seeds.select("seed").distinct(), "starts"), ["seed"], name="_at")
    placed = save(
        numbered.select(
            "seed", F.expr(f"_at div {BITS}").alias("block"), F.expr(f"cast(_at % {BITS} as int)").alias("bit")
        ),
        "seeds",
    )
    start = (
        placed.join(nodes.select(F.col("id").alias("seed"), "degree"), "seed")
        .select(
            F.lit(0).alias("depth"),
            F.col("seed").alias("node"),
            "block",
            F.expr("shiftleft(1L, bit)").alias("mask"),
            piece_count(F.col("degree"), table.piece_rows).alias("pieces"),
        )
    )
    levels = _levels(start, table, max_depth)
    count = placed.count()
    return Reached(placed, reduce(DataFrame.unionByName, levels).drop("pieces"), min(BITS, max(count, 1)))


def _levels(start: DataFrame, table: NeighbourTable, max_depth: int) -> list[DataFrame]:
    """Written levels (depth, node, block, mask, pieces) from ``start``, which is depth 0."""
    levels = [save(start, "level")]
    for depth in range(1, max_depth + 1):
        last = levels[-1]
        frontier = last.select(
            "block", "mask", F.col("node").alias("id"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"),
        )
        found = frontier.join(table.rows, ["id", "piece"]).select(
            F.col("nbr").alias("node"), "block", "mask", F.col("nbr_pieces").alias("pieces"),
            F.lit(0).cast("bigint").alias("seen"),
        )
        before = reduce(DataFrame.unionByName, levels).select(
            "node", "block", F.lit(0).cast("bigint").alias("mask"), "pieces", F.col("mask").alias("seen")
        )
        merged = found.unionByName(before).groupBy("node", "block").agg(
            F.bit_or("mask").alias("_new"), F.bit_or("seen").alias("_seen"), F.max("pieces").alias("pieces")
        )
        level = merged.select(
            F.lit(depth).alias("depth"), "node", "block",
            F.col("_new").bitwiseAND(F.bitwise_not("_seen")).alias("mask"), "pieces",
        ).filter(F.col("mask") != 0)
        saved = save(level, "level")
        if saved.isEmpty():
            break
        levels.append(saved)
    return levels


def level_sizes(reached: Reached, max_depth: int) -> DataFrame:
    """(seed, depth 1..max_depth, frontier_r, new_nodes, visited); ``visited`` counts the start.

    Bits are counted per level by one aggregation; 0 rows for levels without new nodes.
    """
    sums = [F.sum(F.expr(f"shiftright(mask, {b}) & 1L")).alias(f"b{b}") for b in range(reached.bits)]
    wide = reached.levels.groupBy("block", "depth").agg(*sums)
    tall = wide.select("block", "depth", F.posexplode(F.array(*[f"b{b}" for b in range(reached.bits)])).alias("bit", "n"))
    counted = tall.join(reached.seeds, ["block", "bit"]).select("seed", "depth", "n")
    per_seed = [
        F.coalesce(F.sum(F.when(F.col("depth") == d, F.col("n"))), F.lit(0).cast("bigint")).alias(f"d{d}")
        for d in range(max_depth + 1)
    ]
    by_seed = reached.seeds.select("seed").join(counted, "seed", "left").groupBy("seed").agg(*per_seed)
    rows = F.array(
        *[
            F.struct(
                F.lit(d).alias("depth"),
                F.col(f"d{d - 1}").alias("frontier_r"),
                F.col(f"d{d}").alias("new_nodes"),
                reduce(lambda a, b: a + b, [F.col(f"d{i}") for i in range(d + 1)]).alias("visited"),
            )
            for d in range(1, max_depth + 1)
        ]
    )
    return by_seed.select("seed", F.inline(rows))


def bfs_plain(seeds: DataFrame, nodes: DataFrame, table: NeighbourTable, max_depth: int = DEPTH_CAP) -> DataFrame:
    """Level sizes of an unpadded traversal."""
    return level_sizes(reach(seeds, nodes, table, max_depth), max_depth)


def bfs_reachable_count(questions: DataFrame, nodes: DataFrame, table: NeighbourTable, cap: int = DEPTH_CAP) -> DataFrame:
    """(seed, depth, reachable) for rows (seed, depth): depth capped, start excluded, unknown start 0."""
    reached = reach(questions.select("seed"), nodes, table, cap)
    return reachable_counts(questions, reached, cap)


def reachable_counts(questions: DataFrame, reached: Reached, cap: int) -> DataFrame:
    """``bfs_reachable_count`` from a traversal that included all seeds."""
    asked = questions.select("seed", F.least("depth", F.lit(cap)).alias("depth")).distinct()
    sizes = level_sizes(reached, cap).select("seed", "depth", "visited")
    return asked.join(sizes, ["seed", "depth"], "left").select(
        "seed", "depth", F.greatest(F.coalesce("visited", F.lit(0)) - 1, F.lit(0)).cast("bigint").alias("reachable")
    )


def reachable_pairs(pairs: DataFrame, nodes: DataFrame, table: NeighbourTable, hops: int = PAIR_HOPS) -> DataFrame:
    """(src, dst, reachable, min_hops) within ``hops``; a node reaches itself through any neighbour.

    A pair is one bit, and both its ends expand half the hops; they meet on a node that both have reached.  The
    least sum of the two depths over those nodes is the distance, as every node of a shortest path is reached at
    its distance from either end.  No level lies beyond half the hops, which for a hub's neighbourhood is a small
    part of the graph.
    """
    asked = pairs.select("src", "dst").distinct()
    spark = asked.sparkSession
    with scratch(spark):
        numbered = with_positions(save(asked.filter("src <> dst"), "pairs"), ["src", "dst"], name="_at")
        placed = save(
            numbered.select(
                "src", "dst", F.expr(f"_at div {BITS}").alias("block"), F.expr(f"cast(_at % {BITS} as int)").alias("bit")
            ),
            "placed-pairs",
        )

        def side(end: str, depth: int) -> DataFrame:
            masks = placed.groupBy(F.col(end).alias("node"), "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
            known = nodes.select(F.col("id").alias("node"), piece_count(F.col("degree"), table.piece_rows).alias("pieces"))
            start = masks.join(known, "node").select(F.lit(0).alias("depth"), "node", "block", "mask", "pieces")
            found = reduce(DataFrame.unionByName, _levels(start, table, depth))
            return found.select("node", "block", F.col("depth").alias(f"{end}_depth"), F.col("mask").alias(f"{end}_mask"))

        # A node is once in each side's levels for a block and depth, so the join has no hot key.
        near = side("src", hops - hops // 2).join(side("dst", hops // 2), ["node", "block"])
        met = F.col("src_mask").bitwiseAND(F.col("dst_mask"))
        sums = near.groupBy("block", (F.col("src_depth") + F.col("dst_depth")).alias("sum")).agg(F.bit_or(met).alias("met"))
        each = sums.select("block", "sum", "met", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))
        least = each.filter(F.expr("shiftright(met, bit) & 1L") == 1).groupBy("block", "bit").agg(F.min("sum").alias("_hops"))
        apart = placed.join(least, ["block", "bit"], "left").select("src", "dst", "_hops")
        back = nodes.select(F.col("id").alias("dst"), F.col("degree").alias("_degree"))
        loops = asked.filter("src = dst").join(back, "dst", "left").select(
            "src", "dst", F.when((F.col("_degree") > 0) & F.lit(hops >= 2), F.lit(2)).alias("_hops")
        )
        rows = apart.unionByName(loops)
        return keep(save(rows.select(
            "src", "dst", F.col("_hops").isNotNull().alias("reachable"), F.col("_hops").alias("min_hops")
        ), "reached-pairs"))


def expand_frontier(
    blocks: DataFrame, lists: DataFrame, frontier: DataFrame, visited: DataFrame, key: str, keys: Keys
) -> DataFrame:
    """One level: distinct unvisited neighbours (key, node_id) of the frontier (key, node_id).

    ``blocks`` and ``lists`` are what was fetched, decoys included; only
    requested nodes are expanded.
    """
    opened = open_lists(lists, keys)
    wanted = restrict_to_frontier(opened, requested_pieces(blocks, frontier, key), [key, "node_id", "piece"])
    nbrs = wanted.select(key, F.explode("nbrs.nbr").alias("node_id")).distinct()
    return exclude_visited(nbrs, visited, [key, "node_id"])


def bfs_levels(
    starts: DataFrame, store: Store, keys: Keys, max_depth: int = DEPTH_CAP, k: int = 4, scheme: str = "padded"
) -> DataFrame:
    """Padded traversal over the protected store from the few ``starts`` (seed).

    Every level reads p(r) node records: decoys of the store for ``padded``,
    copies of the frontier for ``double``.  One row per start and level
    (seed, depth, frontier_r, p_r, f_r, blocks_fetched, new_nodes, visited).
    """
    if scheme not in ("padded", "double"):
        raise ValueError(f"unknown scheme {scheme!r}")
    known = starts.select("seed", F.col("seed").alias("node_id")).join(
        store.nodes.select("node_id"), "node_id", "left_semi"
    )
    frontier = save(known.select("seed", "node_id"), "frontier")
    visited = frontier
    reports = []
    size = padded_size if scheme == "padded" else doubled_size
    for depth in range(1, max_depth + 1):
        if frontier.isEmpty():
            break
        counts = frontier.groupBy("seed").agg(F.count(F.lit(1)).alias("r"))
        pads = save(pad_table(counts, "seed", size), "frontier-pads")
        if scheme == "padded":
            blocks = lookup_padded(frontier, pads, "seed", store, ["pieces"])
            lists = fetch_lists(blocks, "seed", store)
        else:
            batch = frontier.join(store.nodes.select("node_id", "pieces"), "node_id")
            blocks = save(decoy_copies(batch, "seed", ["node_id"], doubled_size), "fetched")
            lists = fetch_lists(blocks, "seed", store)
        fresh = save(expand_frontier(blocks, lists, frontier, visited, "seed", keys), "frontier")
        read = blocks.groupBy("seed").agg(F.count(F.lit(1)).alias("blocks_fetched"))
        new = fresh.groupBy("seed").agg(F.count(F.lit(1)).alias("new_nodes"))
        reports.append(
            pads.join(read, "seed").join(new, "seed", "left").select(
                "seed", F.lit(depth).alias("depth"), F.col("r").alias("frontier_r"), "p_r",
                shard_size(F.col("p_r"), F.lit(k)).alias("f_r"), "blocks_fetched",
                F.coalesce("new_nodes", F.lit(0).cast("bigint")).alias("new_nodes"),
            )
        )
        visited = visited.unionByName(fresh)
        frontier = fresh
    if not reports:
        raise ValueError("no start is a node of the graph")
    report = save(reduce(DataFrame.unionByName, reports), "levels")
    by_depth = Window.partitionBy("seed").orderBy("depth")  # at most max_depth rows per start
    return report.withColumn("visited", F.sum("new_nodes").over(by_depth) + 1)


def bfs_by_start_class(
    starts: DataFrame, nodes: DataFrame, table: NeighbourTable, max_depth: int = DEPTH_CAP
) -> DataFrame:
    """(class, seed, depth, visited) for starts (class, id): one traversal serves all depths."""
    seeds = starts.select("class", F.col("id").alias("seed"))
    sizes = bfs_plain(seeds, nodes, table, max_depth).select("seed", "depth", "visited")
    return seeds.join(sizes, "seed").select("class", "seed", "depth", "visited")
