"""After a sync the state is the snapshot, and replaying a batch changes nothing."""

import pytest
from pyspark.sql import functions as F

from conftest import LOW_CUTOFFS, pairs_of, rows
from veilgraph.operators.graph import build_graph
from veilgraph.operators.index import build_label_index, label_histogram, open_entries
from veilgraph.operators.protect import build_store, open_lists
from veilgraph.plans.sync import State, added, adjacency_changed, read_state, relabelled, removed, sync_apply, sync_summary
from veilgraph.sources.snapshot import clean_edge_snapshot, clean_node_snapshot
from veilgraph.sources.store import append_nodes, replace_dataset, with_endpoints, write_labelled_snapshot
from veilgraph.streaming.sync_stream import apply_manifests, current_state_path, initialise, start_sync, sync_history

EDGES = [(0, i) for i in range(1, 12)] + [(1, 2), (2, 3), (3, 4), (20, 21)]


@pytest.fixture(scope="module")
def state(spark, keys):
    graph = build_graph(pairs_of(spark, EDGES), LOW_CUTOFFS)
    store = build_store(graph, keys, list_rows=4)
    index = build_label_index(label_histogram(graph.nodes, graph.edges), keys)
    return State(graph.nodes.select("id", "label"), graph.edges.select("u", "v", "label"), store.adjacency, index)


def _snapshot(spark):
    """Node 21 gone, 30 new, 4 relabelled; edge (2, 3) gone, (4, 30) and (5, 6) new, (1, 2) relabelled."""
    nodes = [(str(i), "Inactive") for i in range(12)] + [("20", None), ("30", "Manager"), ("x", "Manager"), (None, "a")]
    edges = [(str(b), str(a), "SEND") for a, b in EDGES if (a, b) not in ((2, 3), (1, 2))]
    edges += [("1", "2", "REPLY"), ("4", "30", None), ("6", "5", "REPLY"), ("y", "2", "SEND")]
    return (
        spark.createDataFrame(nodes, "node_id string, label string"),
        spark.createDataFrame(edges, "src string, dst string, edge_label string"),
    )


def _check(state, keys, nodes, edges):
    assert rows(state.nodes) == rows(nodes)
    assert rows(state.edges) == rows(edges)
    lists = open_lists(state.adjacency, keys).select("node_id", F.inline("nbrs"))
    both = edges.select("u", "v", "label").union(edges.select("v", "u", "label"))
    assert rows(lists) == rows(both)
    entries = open_entries(state.index.entries, keys)
    assert rows(entries.select("kind", "id", "u", "v")) == rows(label_histogram(nodes, edges).drop("label"))
    sizes = {r.token: r.n for r in state.index.entries.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {r.token: r.p_r for r in state.index.sizes.collect()}


def test_state_becomes_the_snapshot(spark, keys, state):
    given = _snapshot(spark)
    nodes = clean_node_snapshot(given[0]).select("id", "label")
    edges = clean_edge_snapshot(given[1])
    new, summary = sync_apply(state, nodes, edges, keys)
    alive = with_endpoints(edges, nodes, "u", "v")
    assert edges.count() == alive.count() + 1  # (20, 21) went with node 21
    _check(new, keys, nodes, alive)
    found = summary.first().asDict()
    assert (found["nodes_added"], found["nodes_removed"]) == (1, 1)
    assert (found["edges_added"], found["edges_removed"]) == (2, 2)
    # The summary alone leaves edges without an endpoint out as well.
    assert sync_summary(state.nodes, state.edges, nodes, edges).first().asDict() == found
    again, second = sync_apply(new, nodes, edges, keys)
    assert again is new and not second.first()["changed"]


def test_untouched_blobs_are_kept(spark, keys, state):
    nodes = state.nodes
    edges = state.edges.union(spark.createDataFrame([(20, 22, "SEND")], "u bigint, v bigint, label string"))
    nodes = nodes.union(spark.createDataFrame([(22, "Inactive")], "id bigint, label string"))
    new, _ = sync_apply(state, nodes, edges, keys)
    old_blobs = {(r.node_id, r.piece): bytes(r.adj_ct) for r in state.adjacency.collect()}
    new_blobs = {(r.node_id, r.piece): bytes(r.adj_ct) for r in new.adjacency.collect()}
    changed = {n for (n, p), b in new_blobs.items() if old_blobs.get((n, p)) != b}
    assert changed == {20, 22}
    old_ct = {bytes(r.ct) for r in state.index.entries.collect()}
    kept = sum(bytes(r.ct) in old_ct for r in new.index.entries.collect())
    assert 0 < kept < new.index.entries.count()


def test_differences(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id bigint, label string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "id bigint, label string")
    assert rows(added(old, new, ["id"])) == [(4, "d")]
    assert rows(removed(old, new, ["id"])) == [(1, "a")]
    assert rows(relabelled(old, new, ["id"])) == [(2, "b", "c")]
    blobs = spark.createDataFrame([(1, b"x"), (2, b"y"), (3, b"z")], "id bigint, adj_ct binary")
    given = spark.createDataFrame([(1, b"x"), (2, b""), (3, b"q"), (4, b"w")], "id bigint, adj_ct binary")
    assert rows(adjacency_changed(blobs, given, ["id"]).select("id")) == [(3,)]


def test_last_row_of_a_pair_wins(spark):
    given = spark.createDataFrame(
        [("1", "2", "REPLY", 1), ("2", "1", "SEND", 2), ("3", "4", None, 1), ("a", "4", "SEND", 1)],
        "src string, dst string, edge_label string, n int",
    )
    assert rows(clean_edge_snapshot(given, "n")) == [(1, 2, "SEND"), (3, 4, "SEND")]


def test_append_is_idempotent(spark):
    nodes = spark.createDataFrame([(1, "Manager")], "id bigint, label string")
    new = spark.createDataFrame([(1,), (2,), (2,)], "id bigint")
    once = append_nodes(nodes, new)
    assert rows(once) == rows(append_nodes(once, new)) == [(1, "Manager"), (2, "Inactive")]


def test_replacing_a_dataset_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_dataset(spark.range(5), path, "a")
    replace_dataset(spark.range(3), path, "b")
    replace_dataset(spark.range(2), path, "a")
    assert rows(spark.read.parquet(path).groupBy("dataset_id").count()) == [("a", 2), ("b", 3)]


def test_stream_and_replay(spark, keys, state, tmp_path):
    root = str(tmp_path)
    write_labelled_snapshot(f"{root}/a", state.nodes, state.edges)
    given = _snapshot(spark)
    given[0].write.parquet(f"{root}/b/nodes")
    given[1].write.parquet(f"{root}/b/edges")
    initialise(state, f"{root}/state")

    def drop(name, path):
        manifest = spark.createDataFrame([(name, path)], "snapshot_id string, path string")
        manifest.coalesce(1).write.mode("append").json(f"{root}/manifests")

    def run():
        start_sync(spark, f"{root}/manifests", f"{root}/state", keys, interval=None).awaitTermination()

    def history():
        found = sync_history(spark, f"{root}/state").filter("batch_id >= 0").orderBy("batch_id")
        return [(r.snapshot_id, r.changed, r.edges_added, r.error is None) for r in found.collect()]

    drop("s1", f"{root}/a")
    drop("s2", f"{root}/b")
    run()
    drop("s3", f"{root}/missing")
    drop("s4", f"{root}/b")
    run()
    want = [("s1", False, 0, True), ("s2", True, 2, True), ("s3", False, 0, False), ("s4", False, 0, True)]
    assert sorted(history()) == want
    before = current_state_path(spark, f"{root}/state", 99)
    batch = sync_history(spark, f"{root}/state").filter("snapshot_id = 's2'").first()["batch_id"]
    apply_manifests(spark, [{"snapshot_id": "s2", "path": f"{root}/b"}], f"{root}/state", batch, keys)
    assert sorted(history()) == want
    assert current_state_path(spark, f"{root}/state", 99) == before


def test_manifests_of_one_file_go_by_number_and_failures_are_replayed(spark, keys, state, tmp_path, monkeypatch):
    root = str(tmp_path)
    given = _snapshot(spark)
    given[0].write.parquet(f"{root}/b/nodes")
    given[1].write.parquet(f"{root}/b/edges")
    write_labelled_snapshot(f"{root}/a", state.nodes, state.edges, state.adjacency.limit(3).withColumn("adj_ct", F.lit(b"x")))
    initialise(state, f"{root}/state")
    manifests = [("s10", f"{root}/a", 10), ("s2", f"{root}/b", 2)]
    spark.createDataFrame(manifests, "snapshot_id string, path string, sequence bigint").coalesce(1).write.json(f"{root}/m")

    def run():
        start_sync(spark, f"{root}/m", f"{root}/state", keys, interval=None).awaitTermination()

    def broken(*_):
        raise RuntimeError("an executor was lost")

    with monkeypatch.context() as failing:
        failing.setattr("veilgraph.streaming.sync_stream.sync_apply", broken)
        with pytest.raises(Exception):
            run()
    assert sync_history(spark, f"{root}/state").filter("batch_id >= 0").count() == 0
    run()
    found = sync_history(spark, f"{root}/state").filter("batch_id >= 0").orderBy("step").collect()
    assert [(r.snapshot_id, r.changed, r.lists_changed) for r in found] == [("s2", True, None), ("s10", True, 3)]
    assert rows(read_state(spark, found[-1].state_path).edges) == rows(state.edges)
