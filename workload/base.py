"""The stored graph the queries run on, built once per session and data folder."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions.crypto import Keys
from veilgraph.operators.graph import Graph, build_graph, pick_by_degree_rank
from veilgraph.operators.index import LabelIndex, build_label_index, label_histogram
from veilgraph.operators.protect import STORE_TABLES, Store, build_store, open_store, store_layout
from veilgraph.plans.traverse import NeighbourTable, neighbour_table
from veilgraph.runtime import fit_partitions, new_path, save
from veilgraph.sources.trade import trade_pairs

# Keys of the checks only; users bring their own.
CHECK_KEYS = {name: hashlib.sha256(name.encode()).hexdigest()[:32].encode() for name in ("content", "token", "index")}


class Workspace:
    """Tables derived from one data folder; each is written when it is first needed."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._written: list[str] = []

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def keys(self) -> Keys:
        return Keys.of(self.spark, **CHECK_KEYS)

    @cached_property
    def graph(self) -> Graph:
        return build_graph(trade_pairs(self.spark, self.sf_dir))

    @property
    def store(self) -> Store:
        return self.sealed(*STORE_TABLES)

    @cached_property
    def _store_path(self) -> str:
        return new_path(self.spark, "protected-store")

    def sealed(self, *tables: str) -> Store:
        """The protected store, opened for ``tables``; each is sealed and written when a query first reads it."""
        missing = [name for name in tables if name not in self._written]
        if missing:
            layout = store_layout(self.spark, self._store_path) if self._written else None
            build_store(self.graph, self.keys, path=self._store_path, tables=missing, layout=layout)
            self._written += missing
        return open_store(self.spark, self._store_path, tables)

    @cached_property
    def index(self) -> LabelIndex:
        return build_label_index(label_histogram(self.graph.nodes, self.graph.edges), self.keys)

    @cached_property
    def neighbour_table(self) -> NeighbourTable:
        return neighbour_table(self.graph)

    @cached_property
    def starts(self) -> DataFrame:
        """(class, id, degree): the high, mid and low degree start."""
        return save(pick_by_degree_rank(self.graph.nodes), "starts")

    @property
    def nodes(self) -> DataFrame:
        return self.graph.nodes

    @property
    def edges(self) -> DataFrame:
        return self.graph.edges

    def labels(self, *more: str) -> DataFrame:
        """(label): every label in use, and some that are not."""
        used = self.nodes.select("label").unionByName(self.edges.select("label")).distinct()
        for name in more:
            used = used.unionByName(used.agg(F.lit(name).alias("label")))
        return save(used, "labels")


# The tables the graph and its snapshots are made of.
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")
_SPACES: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    fit_partitions(spark, *[f"{sf_dir}/{name}.parquet" for name in TABLES])
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SPACES:
        _SPACES[key] = Workspace(spark, sf_dir)
    return _SPACES[key]
