"""From an edge-list file to a labelled, protected, indexed graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions.crypto import Keys
from veilgraph.functions.roles import NODE_CUTOFFS
from veilgraph.operators.graph import Graph, build_graph
from veilgraph.operators.index import (
    LabelIndex, append_to_index, build_label_index, label_histogram, open_index, write_index,
)
from veilgraph.operators.protect import Store, append_to_store, build_store, open_store, store_layout, write_store
from veilgraph.functions.roles import LOWEST_ROLE
from veilgraph.sources.edge_list import scan_edge_list


@dataclass(frozen=True)
class Ingested:
    graph: Graph
    store: Store
    index: LabelIndex
    rejects: DataFrame


def ingest(spark: SparkSession, path: str, keys: Keys, mode: str = "strict", cutoffs=NODE_CUTOFFS) -> Ingested:
    """Scan, label, protect and index; an input without edges is an error, unusable lines are in ``rejects``."""
    found = scan_edge_list(spark, path, mode, written=True)
    graph = build_graph(found.edges, cutoffs)
    index = build_label_index(label_histogram(graph.nodes, graph.edges), keys)
    return Ingested(graph, build_store(graph, keys), index, found.rejects)


def _dataset(path: str, dataset_id: str) -> str:
    return f"{path}/dataset_id={dataset_id}"


def write_protected(store: Store, index: LabelIndex, path: str, dataset_id: str) -> tuple[Store, LabelIndex]:
    """Replace one dataset of the protected tables under ``path``; others stay.

    A dataset has its tables, bucketed as in ``store``, the index with a directory per token, and their layout.
    A store and an index that were never written (``seal_store``, ``label_index_rows``) are sealed where they are written here.
    """
    target = _dataset(path, dataset_id)
    if store.path == target:
        raise ValueError("a store is not written over itself")
    spark = store.nodes.sparkSession
    return write_store(store, target, store.layout or store_layout(spark, store.path)), write_index(index, target)


def read_protected(spark: SparkSession, path: str, dataset_id: str) -> tuple[Store, LabelIndex]:
    """The protected tables of one dataset as ``write_protected`` left them, in any session.

    Reads by key move the asked rows only, a label opens its own directory, and both can be appended to.
    """
    target = _dataset(path, dataset_id)
    return open_store(spark, target), open_index(spark, f"{target}/index", f"{target}/sizes")


def append_protected(store: Store, index: LabelIndex, new_ids: DataFrame, keys: Keys) -> tuple[Store, LabelIndex]:
    """Nodes that the store lacks, with the lowest role, and their index entries, in one step.

    Only files are added: one for each touched bucket, one segment of the index.
    """
    before = store.n_nodes
    after = append_to_store(store, new_ids, keys)
    if after.n_nodes == before:
        return after, index
    added = after.nodes.filter(F.col("pos") >= before).select(F.col("node_id").alias("id"))
    null = F.lit(None).cast("bigint")
    rows = added.select(
        F.lit(LOWEST_ROLE).alias("label"), F.lit("v").alias("kind"), "id", null.alias("u"), null.alias("v")
    )
    return after, append_to_index(index, rows, keys)
