"""What the protected path leaves on disk: tokens, hashes, sizes, owners' ids and ciphertexts, no labels or entries."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import LOW_CUTOFFS, pairs_of, rows
from veilgraph.functions.crypto import Keys
from veilgraph.operators.adjacency import build_adjacency
from veilgraph.operators.graph import build_graph
from veilgraph.operators.index import (
    build_label_index, fetch_entries, index_lookup, label_histogram, open_entries, rebuild_label_index,
)
from veilgraph.operators.lookup import fetch_lists
from veilgraph.operators.padding import decoy_window
from veilgraph.operators.protect import NODE_RECORD, append_to_store, build_store, open_rows
from veilgraph.sources.store import append_nodes
from veilgraph.plans.labels import label_query, node_degree_padded
from veilgraph.plans.pattern import match_pattern_batch, match_pattern_protected, pattern_table

EDGES = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 28)] + [(40, 41)]


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def graph(spark):
    return build_graph(pairs_of(spark, EDGES), LOW_CUTOFFS)


@pytest.fixture(scope="module")
def store(graph, keys):
    return build_store(graph, keys, list_rows=4)


def test_no_plain_column_is_written(spark, keys, graph, shared_folder):
    histogram = label_histogram(graph.nodes, graph.edges)
    before = files(shared_folder)
    store = build_store(graph, keys, list_rows=4)
    index = build_label_index(histogram, keys)
    labels = spark.createDataFrame([("External",), ("SEND",)], "label string")
    answers, report = label_query(index, labels, store, keys)
    assert answers.count() == sum(r.r_true for r in report.collect()) > 0
    written = files(shared_folder) - before
    assert written
    for path in written:
        names = set(pq.read_schema(path).names)
        assert not names & {"label", "kind", "id", "u", "v"}, path


def test_a_build_leaves_its_results_only(graph, keys, shared_folder):
    before = files(shared_folder)
    build_label_index(label_histogram(graph.nodes, graph.edges), keys)
    left = {os.path.relpath(p, shared_folder).split(os.sep)[2].rsplit("-", 1)[0] for p in files(shared_folder) - before}
    assert left == {"label-index", "label-index-sizes"}


def test_entries_of_a_long_label_have_one_length(spark, keys):
    nodes = spark.createDataFrame([(k, "L" * 200 if k % 2 else "s") for k in range(40)], "id bigint, label string")
    edges = spark.createDataFrame([], "u bigint, v bigint, label string")
    index = build_label_index(label_histogram(nodes, edges), keys)
    assert index.entries.select(F.length("ct")).distinct().count() == 1
    assert open_entries(index.entries, keys).count() == 40


def test_a_lookup_opens_only_the_asked_directories(spark, keys, graph):
    index = build_label_index(label_histogram(graph.nodes, graph.edges), keys)
    found = fetch_entries(index, spark.createDataFrame([("External",)], "label string"), keys)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruning = [line for line in plan.splitlines() if "PartitionFilters" in line and "token" in line]
    assert any("PartitionFilters: [isnotnull(token" in line or "IN (" in line or "(token" in line for line in pruning), plan


def test_lists_are_read_without_moving_them(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blocks = store.nodes.select(F.lit("q").alias("key"), "node_id", "pieces")
        wanted = blocks.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
        joined = wanted.join(store.adjacency, ["node_id", "piece"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange ") == 1, plan  # of the asked pieces only
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lists = fetch_lists(store.nodes.select(F.lit("q").alias("key"), "node_id", "pieces"), "key", store)
    assert lists.count() == store.adjacency.count()


def test_many_requests_share_a_window(spark):
    store = spark.range(0, 500).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("node_id"))
    pads = spark.range(0, 10_000).select(
        F.col("id").cast("string").alias("key"), F.lit(1).alias("r"), F.lit(2).alias("p_r"), F.lit(1).alias("dummies")
    )
    found = decoy_window(pads, "key", store, 500)
    assert found.count() == 10_000
    assert found.select("node_id").distinct().count() == 1


def test_more_patterns_than_any_list(spark, keys, graph, store):
    names = [(f"S{k}", "SEND", "External") for k in range(1500)]
    real = [("External", "INTERNAL", "External"), ("Employee", "INTERNAL", "Employee")]
    patterns = pattern_table(spark, names + real)
    plain = {r.pattern: r.matches for r in match_pattern_batch(graph, patterns).collect()}
    assert len(plain) == 1502
    for scheme in ("padded", "double"):
        _, report = match_pattern_protected(patterns, graph.nodes, store, keys, scheme)
        assert {r.pattern: r.matches for r in report.collect()} == plain


def test_degree_comes_from_the_lists(spark, keys, graph, store):
    ids = graph.nodes.select("id")
    found = {r.id: (r.degree, r.p_r, r.scanned) for r in node_degree_padded(ids, store, keys).collect()}
    degrees = {r.id: r.degree for r in graph.nodes.collect()}
    assert found == {i: (d, 2 * d, 2 * d) for i, d in degrees.items()}
    bare = type(store)(store.nodes, store.edges, store.adjacency.limit(0), store.n_nodes, store.n_edges)
    assert {r.degree for r in node_degree_padded(ids, bare, keys).collect()} == {0}
    other = Keys.of(spark, content=b"x" * 32, token=b"t" * 32, index=b"i" * 32)
    with pytest.raises(Exception):
        node_degree_padded(ids, store, other).collect()
    assert rows(build_adjacency(graph.edges, 4).select("id").distinct()) == rows(ids)


def test_append_writes_store_and_index(spark, keys, graph):
    store = build_store(graph, keys, list_rows=4)
    index = build_label_index(label_histogram(graph.nodes, graph.edges), keys)
    new = spark.createDataFrame([(0,), (900,), (901,), (901,)], "id bigint")
    once = append_to_store(store, new, keys)
    again = append_to_store(once, new, keys)
    assert again.n_nodes == once.n_nodes == store.n_nodes + 2
    assert sorted(r.pos for r in again.nodes.collect()) == list(range(again.n_nodes))
    found = open_rows(again.nodes.filter("node_id >= 900"), keys, "ct", NODE_RECORD)
    assert rows(found.select("record.id", "record.label")) == [(900, "Inactive"), (901, "Inactive")]
    after = append_nodes(graph.nodes, new)
    lowest = spark.createDataFrame([("Inactive",)], "label string")
    fresh = rebuild_label_index(index, label_histogram(after, graph.edges), lowest, keys)
    assert {900, 901} <= {r.id for r in index_lookup(fresh, lowest, keys).collect()}
