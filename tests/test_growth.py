"""What a build writes and moves stays near the size of its results, and tasks grow in number, not in size."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import LOW_CUTOFFS, pairs_of, rows
from test_protected_files import files
from veilgraph import runtime
from veilgraph.operators import index as index_module
from veilgraph.operators import protect
from veilgraph.operators.graph import build_graph
from veilgraph.operators.index import build_label_index, index_lookup, label_histogram, open_entries
from veilgraph.operators.protect import EDGE_RECORD, NODE_RECORD, build_store, open_lists, open_rows

EDGES = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 28)] + [(40, 41)]


@pytest.fixture(scope="module")
def graph(spark):
    return build_graph(pairs_of(spark, EDGES), LOW_CUTOFFS)


@pytest.fixture
def saved(monkeypatch):
    """Columns of what the protected builds write on the way."""
    found = []

    def watch(module):
        real = module.save

        def save(df, name, *args, **kwargs):
            found.append((name, set(df.columns)))
            return real(df, name, *args, **kwargs)

        monkeypatch.setattr(module, "save", save)

    watch(protect)
    watch(index_module)
    return found


def test_a_record_is_sealed_where_it_is_written(graph, keys, saved):
    store = build_store(graph, keys, list_rows=4)
    build_label_index(label_histogram(graph.nodes, graph.edges), keys)
    assert [n for n, columns in saved if columns & {"ct", "adj_ct"}] == ["label-index"]
    nodes = open_rows(store.nodes, keys, "ct", NODE_RECORD).select("node_id", "record.id", "record.label", "pos")
    assert rows(nodes.select("id", "label")) == rows(graph.nodes.select("id", "label"))
    assert [r.pos for r in nodes.orderBy("id").collect()] == list(range(store.n_nodes))
    edges = open_rows(store.edges, keys, "ct", EDGE_RECORD).select("record.src", "record.dst", "record.label", "pos")
    assert rows(edges.select("src", "dst", "label")) == rows(graph.edges.select("u", "v", "label"))
    assert [r.pos for r in edges.orderBy("src", "dst").collect()] == list(range(store.n_edges))
    assert open_lists(store.adjacency, keys).agg(F.sum(F.size("nbrs"))).first()[0] == 2 * store.n_edges


def test_slots_do_not_depend_on_how_a_label_is_cut(spark, keys, monkeypatch):
    nodes = spark.createDataFrame([(k, "big" if k % 5 else "small") for k in range(500)], "id bigint, label string")
    edges = spark.createDataFrame([(0, 1, None), (1, 2, None), (2, 3, "big")], "u bigint, v bigint, label string")
    histogram = label_histogram(nodes, edges)
    labels = nodes.select("label").distinct()
    whole = build_label_index(histogram, keys)
    monkeypatch.setattr(index_module, "SLOT_ROWS", 7)
    cut = build_label_index(histogram, keys)
    assert cut.entries.count() == whole.entries.count()
    assert rows(index_lookup(cut, labels, keys)) == rows(index_lookup(whole, labels, keys))
    for token in cut.entries.groupBy("token").agg(F.sort_array(F.collect_list("slot")).alias("slots")).collect():
        assert token.slots == list(range(len(token.slots)))
    assert open_entries(cut.entries, keys).count() == 503


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    (tmp_path / "table.parquet").write_bytes(b"x" * 1000)
    monkeypatch.setattr(runtime, "PARTITION_BYTES", 10)
    session = spark.newSession()
    runtime.fit_partitions(session, str(tmp_path / "table.parquet"))
    assert session.conf.get(name) == "100"
    runtime.fit_partitions(session, os.path.join(tmp_path, "table.parquet"), str(tmp_path / "table.parquet"))
    assert session.conf.get(name) == "200"
    assert session.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "10"


def test_copying_a_store_moves_nothing(spark, keys, graph, tmp_path):
    store = build_store(graph, keys, list_rows=4)
    buckets = protect.store_layout(spark, store.path).edge_buckets
    with runtime.setting(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
        assert store.edges.rdd.getNumPartitions() == buckets
    copy = protect.write_store(store, str(tmp_path / "copy"), protect.store_layout(spark, store.path))
    assert rows(copy.edges.select("src", "dst", "pos")) == rows(store.edges.select("src", "dst", "pos"))
    assert len(files(str(tmp_path / "copy" / "edges"))) <= buckets
