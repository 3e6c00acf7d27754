"""A sync writes the touched parts and its manifest only; digests, summaries and the pointer agree with whole comparisons."""

import os
import random

import pytest

from conftest import LOW_CUTOFFS, pairs_of, rows
from test_store_layout import stamps
from test_sync import _check
from veilgraph.operators.graph import build_graph
from veilgraph.operators.index import build_label_index, label_histogram
from veilgraph.operators.protect import build_store
from veilgraph.plans import sync
from veilgraph.plans.sync import State, changes, read_state, summary_of, sync_apply, sync_summary, write_state
from veilgraph.sources.store import with_endpoints, write_labelled_snapshot
from veilgraph.streaming import sync_stream

EDGES = [(0, i) for i in range(1, 12)] + [(1, 2), (2, 3), (3, 4), (20, 21)]
LABELS = ["Inactive", "External", "Manager"]


@pytest.fixture(scope="module")
def state(spark, keys):
    graph = build_graph(pairs_of(spark, EDGES), LOW_CUTOFFS)
    store = build_store(graph, keys, list_rows=4)
    index = build_label_index(label_histogram(graph.nodes, graph.edges), keys)
    return State(graph.nodes.select("id", "label"), graph.edges.select("u", "v", "label"), store.adjacency, index)


def tables(spark, nodes, edges):
    return (
        spark.createDataFrame(sorted(nodes.items()), "id bigint, label string"),
        spark.createDataFrame([(u, v, x) for (u, v), x in sorted(edges.items())], "u bigint, v bigint, label string"),
    )


def test_a_changed_edge_touches_its_parts_only(spark, keys, state, tmp_path):
    old = write_state(state, str(tmp_path / "one"))
    before = stamps(tmp_path)
    edges = state.edges.filter("NOT (u = 20 AND v = 21)")
    new, summary = sync_apply(old, state.nodes, edges, keys, str(tmp_path / "two"))
    assert summary.first()["edges_removed"] == 1
    after = stamps(tmp_path)
    assert before.items() <= after.items()  # nothing is rewritten
    added = {os.path.relpath(p, tmp_path).split(os.sep)[0] for p in after.keys() - before.keys()}
    assert added <= {"edges", "adjacency", "index", "sizes"}
    changed = [p for p in new.parts if p not in old.parts]
    assert len([p for p in changed if p.table == "edges"]) <= 1 and len([p for p in changed if p.table == "adjacency"]) <= 2
    assert not [p for p in changed if p.table == "nodes"]
    _check(new, keys, state.nodes, edges)
    _check(old, keys, state.nodes, state.edges)  # the state before is still whole
    again, _ = sync_apply(old, state.nodes, edges, keys, str(tmp_path / "two"))  # a replay
    key = lambda p: (p.table, p.part)
    assert sorted(again.parts, key=key) == sorted(new.parts, key=key)
    _check(again, keys, state.nodes, edges)


def test_an_unchanged_snapshot_compares_nothing(spark, keys, state, tmp_path, monkeypatch):
    old = write_state(state, str(tmp_path / "one"))
    opened = []
    real = sync._open
    monkeypatch.setattr(sync, "_open", lambda spark, path, name, parts: opened.extend(parts := list(parts)) or real(spark, path, name, parts))
    same, summary = sync_apply(old, state.nodes, state.edges, keys)
    assert same is old and not summary.first()["changed"] and not opened


def test_random_changes(spark, keys, state, tmp_path):
    r = random.Random(3)
    nodes = {x.id: x.label for x in state.nodes.collect()}
    edges = {(x.u, x.v): x.label for x in state.edges.collect()}
    now = write_state(state, str(tmp_path / "v0"))
    for step in range(4):
        for _ in range(r.randrange(4)):
            nodes.pop(r.choice(sorted(nodes)))
        for _ in range(r.randrange(4)):
            nodes[r.randrange(60)] = r.choice(LABELS)
        for _ in range(r.randrange(5)):
            edges.pop(r.choice(sorted(edges)), None)
        for _ in range(r.randrange(6)):
            a, b = sorted(r.sample(range(60), 2))
            edges[a, b] = r.choice(["SEND", "REPLY"])
        given = tables(spark, nodes, edges)  # it may list edges without an end
        alive = with_endpoints(given[1], given[0], "u", "v")
        whole = summary_of(changes(now.nodes, given[0], ["id"]), changes(now.edges, alive, ["u", "v"])).first()
        assert sync_summary(now.nodes, now.edges, *given).first() == whole
        now, summary = sync_apply(now, *given, keys, str(tmp_path / f"v{step + 1}"))
        assert summary.first() == whole
        _check(now, keys, given[0], alive)
        _check(read_state(spark, now.path), keys, given[0], alive)


def test_history_is_merged(spark, keys, state, tmp_path, monkeypatch):
    monkeypatch.setattr(sync_stream, "MERGE_EVERY", 3)
    root = str(tmp_path)
    write_labelled_snapshot(f"{root}/a", state.nodes, state.edges)
    write_labelled_snapshot(f"{root}/b", state.nodes, state.edges.filter("u <> 20"))
    sync_stream.initialise(state, f"{root}/state")
    for batch in range(7):
        drop = [{"snapshot_id": f"s{batch}", "path": f"{root}/{'ab'[batch % 2]}"}]
        sync_stream.apply_manifests(spark, drop, f"{root}/state", batch, keys)
    files = [p for p in stamps(f"{root}/state/history")] + [p for p in stamps(f"{root}/state/merged")]
    assert len(files) <= 4
    found = sync_stream.sync_history(spark, f"{root}/state").orderBy("batch_id").collect()
    assert [(r.batch_id, r.snapshot_id) for r in found] == [(-1, "initial")] + [(k, f"s{k}") for k in range(7)]
    assert [r.changed for r in found] == [False, False] + [True] * 6
    newest = sync_stream.current_state_path(spark, f"{root}/state", 99)
    assert newest == found[-1].state_path
    assert sync_stream.current_state_path(spark, f"{root}/state", 6) == found[-2].state_path
    assert sync_stream.current_state_path(spark, f"{root}/state", 2) == found[2].state_path
    sync_stream.apply_manifests(spark, [{"snapshot_id": "s6", "path": f"{root}/a"}], f"{root}/state", 6, keys)  # a replay
    again = sync_stream.sync_history(spark, f"{root}/state").orderBy("batch_id").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in found]
    assert rows(read_state(spark, newest).edges.select("u", "v")) == rows(state.edges.select("u", "v"))


def test_the_index_of_a_state_is_written_once(spark, keys, state, tmp_path, monkeypatch):
    old = write_state(state, str(tmp_path / "one"))
    from veilgraph.operators import index as index_module

    real, saved = index_module.save, []
    monkeypatch.setattr(index_module, "save", lambda df, name, *more: saved.append((name, df.columns)) or real(df, name, *more))
    edges = state.edges.filter("NOT (u = 20 AND v = 21)")
    new, _ = sync_apply(old, state.nodes, edges, keys, str(tmp_path / "two"))
    assert saved and not [name for name, columns in saved if "ct" in columns]
    _check(new, keys, state.nodes, edges)
