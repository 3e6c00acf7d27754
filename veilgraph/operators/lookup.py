"""Reads from the protected store by id, exact or padded.

A padded read is written before anything filters it.  Otherwise the optimizer
could move the filter for the wanted rows below the read, and the padding
would exist on paper only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.operators.padding import decoy_window, few_decoy_windows, window_bounds
from veilgraph.operators.protect import Store
from veilgraph.operators.skew import HUB_ROWS, Dimension, attach, repeat_rows
from veilgraph.runtime import keep, save, scratch

# So many ids are also named in the scan, which then opens only their buckets.
NAMED_IDS = 1000


def lookup_plain(ids: DataFrame, table: DataFrame, key: str = "node_id") -> DataFrame:
    """The rows of ``ids`` (key) in ``table``; missing ids drop out, repeated ids repeat.

    Repeats are counted before the shuffle and restored after the join.
    """
    counted = ids.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    found = counted.join(table, key)
    return repeat_rows(found, F.col("_n"), [key], index="_i").drop("_n", "_i")


def lookup_padded(
    requests: DataFrame, pads: DataFrame, key: str, store: Store, columns: list[str]
) -> DataFrame:
    """Read the requested nodes and the decoys of every ``key`` as one written set.

    ``requests`` (key, node_id) has no repeats; ``pads`` (key, r, p_r, dummies).
    The set (key, node_id, columns) does not tell decoys from requested rows.
    """
    places = store.node_places if store.node_places is not None else store.nodes.select("pos", "node_id")
    table = store.nodes.select("node_id", *columns)
    return _read_padded(requests, pads, key, table, places, store.n_nodes, ["node_id"], "fetched")


def lookup_padded_edges(requests: DataFrame, pads: DataFrame, key: str, store: Store) -> DataFrame:
    """As ``lookup_padded`` for edges: requests (key, src, dst) -> (key, src, dst, ct)."""
    places = store.edge_places if store.edge_places is not None else store.edges.select("pos", "src", "dst")
    table = store.edges.select("src", "dst", "ct")
    return _read_padded(requests, pads, key, table, places, store.n_edges, ["src", "dst"], "fetched-edges")


def _read_padded(
    requests: DataFrame, pads: DataFrame, key: str, table: DataFrame, places: DataFrame, total: int, ids: list[str], name: str
) -> DataFrame:
    """Requested rows and decoys of ``table`` by their ids, written; what tells them apart is deleted.

    Decoys are chosen from the narrow ``places``, so the table is read by its ids alone: bucketed on them it is not
    moved, and a short list of ids names the buckets that are opened.
    """
    with scratch(table.sparkSession):
        n_keys, reads, low, high = pads.agg(F.count(F.lit(1)), F.sum("p_r"), *window_bounds(total)).first()
        if 2 * n_keys <= HUB_ROWS:  # a key asks for a row twice at most, so no row is asked for more often
            decoys = few_decoy_windows(pads, key, places, total, low or 0, high or 0, reads or 0)
            wanted = requests.select(key, *ids).unionByName(decoys.select(key, *ids))
            if (reads or 0) <= NAMED_IDS:
                wanted = save(wanted, "wanted")
                table = table.filter(_named(ids[0], wanted))
            return keep(save(wanted.join(table, ids).select(key, *table.columns), name))
        decoys = decoy_window(pads, key, places, total)
        wanted = save(requests.select(key, *ids).unionByName(decoys.select(key, *ids)), "wanted")
        asked = wanted.groupBy(*ids).agg(F.count(F.lit(1)).alias("_asked"))
        found = save(asked.join(table, ids).withColumn("_id", F.struct(*ids)), "asked-rows")
        lost = -1 - F.pmod(F.xxhash64(key, *ids), F.lit(1 << 62))
        scatter = F.struct(lost.alias(ids[0]), *[F.lit(-1).cast("bigint").alias(c) for c in ids[1:]])
        columns = {c: c for c in table.columns if c not in ids}
        rows = attach(wanted.withColumn("_own", F.struct(*ids)), "_own", Dimension.of(found, "_id", "_asked"), columns, scatter)
        return keep(save(rows.filter(F.col(next(iter(columns))).isNotNull()).select(key, *ids, *columns), name))


def _named(column: str, wanted: DataFrame) -> Column:
    """Filter for the ids of a short written list, which prunes buckets and row groups."""
    return F.col(column).isin([r[0] for r in wanted.select(column).distinct().collect()])


def fetch_lists(blocks: DataFrame, key: str, store: Store) -> DataFrame:
    """The neighbour-list pieces of fetched nodes (key, node_id, pieces), written.

    The join key (node_id, piece) splits hubs over many join groups.  For a short list of nodes the scan skips the
    row groups of others.
    """
    wanted = repeat_rows(
        blocks.select(key, "node_id", "pieces"), F.col("pieces"), [key, "node_id"], index="piece", written=True
    )
    lists = store.adjacency
    if blocks.limit(NAMED_IDS + 1).count() <= NAMED_IDS:
        lists = lists.filter(_named("node_id", blocks))
    return save(
        wanted.join(lists, ["node_id", "piece"]).select(key, "node_id", "piece", "adj_ct"), "fetched-lists"
    )


def adjacency_or_empty(nodes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Every list piece of every node; a node without edges has one empty blob.

    ``nodes`` (node_id, pieces, ...), ``adjacency`` (node_id, piece, adj_ct).
    """
    pieces = repeat_rows(nodes, F.col("pieces"), ["node_id"], index="piece")
    return pieces.join(adjacency, ["node_id", "piece"], "left").withColumn(
        "adj_ct", F.coalesce("adj_ct", F.lit("").cast("binary"))
    )


def requested_pieces(blocks: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """(key, node_id, piece) of the requested ones among the fetched ``blocks`` (key, node_id, pieces)."""
    own = blocks.select(key, "node_id", "pieces").distinct().join(
        requests.select(key, "node_id"), [key, "node_id"], "left_semi"
    )
    return repeat_rows(own, F.col("pieces"), [key, "node_id"], index="piece").drop("pieces")


def restrict_to_frontier(rows: DataFrame, pieces: DataFrame, on: list[str]) -> DataFrame:
    """Keep the rows of requested owners.

    ``on`` names the owner and its piece, so the rows of a hub come from many join groups.
    """
    return rows.join(pieces.select(*on), on, "left_semi")


def exclude_visited(candidates: DataFrame, visited: DataFrame, on: list[str]) -> DataFrame:
    """Drop what was reached before."""
    return candidates.join(visited.select(*on), on, "left_anti")


def attach_neighbour_label(rows: DataFrame, nodes: DataFrame, dim: Dimension | None = None) -> DataFrame:
    """Add ``nbr_label`` to rows with a ``nbr``; hub neighbours are looked up by broadcast."""
    dim = dim or Dimension.of(nodes, "id", "degree")
    return attach(rows, "nbr", dim, {"label": "nbr_label"}, F.xxhash64(*rows.columns))
