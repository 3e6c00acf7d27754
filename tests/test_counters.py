"""Counters that follow random changes equal those of the graph counted anew."""

import random

import pytest

from conftest import rows
from veilgraph.operators.graph import degrees, graph_stats, label_counts
from veilgraph.operators.padding import protect_stats
from veilgraph.plans import counters
from veilgraph.plans.sync import changes, edge_changes

LABELS = ["Inactive", "External", "Manager"]


def tables(spark, nodes, edges):
    return (
        spark.createDataFrame(sorted(nodes.items()), "id bigint, label string"),
        spark.createDataFrame([(u, v, x) for (u, v), x in sorted(edges.items())], "u bigint, v bigint, label string"),
    )


def mutated(r, nodes, edges):
    nodes, edges = dict(nodes), dict(edges)
    for _ in range(r.randrange(1, 6)):
        nodes[r.randrange(60)] = r.choice(LABELS)
    for gone in r.sample(sorted(nodes), 2):
        del nodes[gone]
    for _ in range(8):
        u, v = sorted(r.sample(sorted(nodes), 2))
        edges[u, v] = r.choice(("SEND", "REPLY"))
    for gone in r.sample(sorted(edges), 3):
        del edges[gone]
    return nodes, {(u, v): x for (u, v), x in edges.items() if u in nodes and v in nodes}


def check(found, nodes, edges):
    known = nodes.join(degrees(edges), "id", "left").fillna(0, "degree")
    assert rows(counters.graph_stats_of(found)) == rows(graph_stats(known, edges))
    per_label = label_counts(nodes, edges)
    assert rows(counters.label_counts_of(found)) == rows(per_label)
    wanted = protect_stats(nodes, edges, per_label.withColumnRenamed("n", "r"))
    assert rows(counters.protect_stats_after(found)) == rows(wanted)
    assert rows(found.histogram) == rows(known.groupBy("degree").count())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes(spark, seed):
    r = random.Random(seed)
    nodes = {k: r.choice(LABELS) for k in range(40)}
    edges = {tuple(sorted(r.sample(range(40), 2))): "SEND" for _ in range(60)}
    before = tables(spark, nodes, edges)
    found = counters.counters_of(*before, n_parts=8)
    check(found, *before)
    for _ in range(3):
        nodes, edges = mutated(r, nodes, edges)
        after = tables(spark, nodes, edges)
        node_changes = changes(before[0], after[0], ["id"])
        found = counters.update_counters(found, node_changes, edge_changes(before[1], after[1], node_changes, after[0]))
        check(found, *after)
        before = after


def test_an_edge_touches_two_parts_only(spark):
    nodes = {k: "External" for k in range(200)}
    edges = {(k, k + 1): "SEND" for k in range(199)}
    before = tables(spark, nodes, edges)
    first = counters.counters_of(*before, n_parts=64)
    del edges[3, 4]
    edges[10, 90] = edges[10, 11] = "REPLY"
    after = tables(spark, nodes, edges)
    none = changes(before[0], after[0], ["id"])
    second = counters.update_counters(first, none, changes(before[1], after[1], ["u", "v"]))
    check(second, *after)
    moved = {p for p in first.parts if first.parts[p] != second.parts[p]}
    assert 1 <= len(moved) <= 4 and first.parts.keys() == second.parts.keys()
    third = counters.update_counters(second, none, changes(after[1], after[1], ["u", "v"]))
    assert third.parts == second.parts
    check(third, *after)
