"""Padded, doubled and plain answers agree with each other and with plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import LOW_CUTOFFS, pairs_of, rows
from veilgraph.functions.crypto import unseal
from veilgraph.operators.graph import build_graph
from veilgraph.operators.index import build_label_index, label_histogram
from veilgraph.operators.lookup import lookup_padded
from veilgraph.operators.padding import pad_table
from veilgraph.operators.protect import build_store
from veilgraph.plans.labels import label_count_index, label_count_scan, label_query, node_degree_padded, node_degree_sample
from veilgraph.plans.pattern import match_pattern_batch, match_pattern_plain, match_pattern_protected, pattern_table
from veilgraph.plans.traverse import (
    bfs_by_start_class,
    bfs_levels,
    bfs_plain,
    bfs_reachable_count,
    neighbour_table,
    reachable_pairs,
)
from veilgraph.runtime import save


def _edges(seed, n, m):
    rng = random.Random(seed)
    found = {tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(m)}
    found |= {(0, i) for i in range(1, n // 2)}  # a hub with id 0
    return sorted((a, b) for a, b in found if a != b)


def _levels(edges, start, depth):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    if start not in near:
        return None
    seen, frontier, sizes = {start}, {start}, []
    for _ in range(depth):
        frontier = set().union(*(near[x] for x in frontier)) - seen if frontier else set()
        seen |= frontier
        sizes.append(len(frontier))
    return sizes


@pytest.fixture(scope="module", params=[1])
def world(request, spark, keys):
    edges = _edges(request.param, 90, 110)
    graph = build_graph(pairs_of(spark, edges + [(b, a) for a, b in edges[:20]] + [(5, 5)]), LOW_CUTOFFS, hub_rows=10)
    store = build_store(graph, keys, list_rows=4)
    index = build_label_index(label_histogram(graph.nodes, graph.edges), keys)
    return edges, graph, store, index, neighbour_table(graph, piece_rows=4)


def test_traversal_from_every_node(spark, world):
    """More starts than one mask holds; hubs in pieces of four neighbours."""
    edges, graph, _, _, table = world
    seeds = graph.nodes.select(F.col("id").alias("seed"))
    found = {(r.seed, r.depth): (r.frontier_r, r.new_nodes, r.visited) for r in bfs_plain(seeds, graph.nodes, table).collect()}
    assert seeds.count() > 62
    for (seed,) in rows(seeds):
        sizes = [1, *_levels(edges, seed, 3)]
        for d in (1, 2, 3):
            assert found[(seed, d)] == (sizes[d - 1], sizes[d], sum(sizes[: d + 1]))


@pytest.mark.parametrize("scheme", ["padded", "double"])
def test_padded_traversal_sees_the_same_nodes(spark, keys, world, scheme):
    edges, graph, store, _, _ = world
    starts = spark.createDataFrame([(0,), (3,), (777,)], "seed bigint")
    for k in (1,) if scheme == "double" else (1, 4):
        for r in bfs_levels(starts, store, keys, k=k, scheme=scheme).collect():
            sizes = [1, *_levels(edges, r.seed, 3)]
            assert (r.frontier_r, r.new_nodes, r.visited) == (sizes[r.depth - 1], sizes[r.depth], sum(sizes[: r.depth + 1]))
            assert r.blocks_fetched == r.p_r or r.blocks_fetched == r.frontier_r + store.n_nodes
            assert r.f_r == -(-r.p_r // k)


def test_reachable_counts(spark, world):
    edges, graph, _, _, table = world
    asked = spark.createDataFrame([(0, 2), (3, 9), (777, 2), (3, 0)], "seed bigint, depth int")
    found = {(r.seed, r.depth): r.reachable for r in bfs_reachable_count(asked, graph.nodes, table).collect()}
    assert found == {
        (0, 2): sum(_levels(edges, 0, 2)), (3, 3): sum(_levels(edges, 3, 3)), (777, 2): 0, (3, 0): 0,
    }


def test_pairs(spark, world):
    edges, graph, _, _, table = world
    ids = [r.id for r in graph.nodes.collect()] + [777]
    pairs = [(a, b) for a in ids[::7] + [777] for b in ids[::5] + [a]]
    found = {
        (r.src, r.dst): (r.reachable, r.min_hops)
        for r in reachable_pairs(spark.createDataFrame(pairs, "src bigint, dst bigint"), graph.nodes, table).collect()
    }
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for src, dst in pairs:
        hops, seen, frontier = None, {src}, {src} if src in near else set()
        for d in range(1, 5):
            step = set().union(*(near[x] for x in frontier)) if frontier else set()
            if dst in step:
                hops = d
                break
            frontier = step - seen
            seen |= frontier
        assert found[(src, dst)] == (hops is not None, hops), (src, dst)


def test_start_grid(spark, world):
    edges, graph, _, _, table = world
    starts = spark.createDataFrame([("high", 0), ("low", 3)], "class string, id bigint")
    found = rows(bfs_by_start_class(starts, graph.nodes, table))
    assert len(found) == 2 * 3
    assert ("high", 0, 2, 1 + sum(_levels(edges, 0, 2))) in found


def test_patterns_agree(spark, keys, world):
    _, graph, store, _, _ = world
    names = [r.label for r in graph.nodes.select("label").distinct().collect()]
    triples = [(a, e, b) for a in names for e in ("SEND", "REPLY", "BROADCAST", "INTERNAL") for b in names]
    patterns = save(pattern_table(spark, triples), "t")
    batch = {r.pattern: r.matches for r in match_pattern_batch(graph, patterns).collect()}
    assert sum(batch.values()) == 2 * graph.edges.count()
    plain = {(r.src, r.dst) for r in match_pattern_plain(graph, "Executive", "BROADCAST", "Employee").collect()}
    for scheme in ("padded", "double"):
        pairs, report = match_pattern_protected(patterns, graph.nodes, store, keys, scheme)
        assert {r.pattern: r.matches for r in report.collect()} == batch
        own = pairs.filter("pattern = 'Executive-[BROADCAST]->Employee'")
        assert {(r.src, r.dst) for r in own.collect()} == plain
        assert pairs.count() == pairs.distinct().count()


def test_labels_agree(spark, keys, world):
    _, graph, store, index, _ = world
    used = graph.nodes.select("label").unionByName(graph.edges.select("label")).distinct()
    labels = save(used.unionByName(spark.createDataFrame([("Nobody",)], "label string")), "t")
    truth = rows(label_histogram(graph.nodes, graph.edges))
    counts = {}
    for label, *_ in truth:
        counts[label] = counts.get(label, 0) + 1
    for padded in (True, False):
        answers, report = label_query(index, labels, store, keys, padded)
        assert rows(answers) == truth
        for r in report.collect():
            assert r.r_true == r.confirmed == counts[r.label]
            assert r.blocks_fetched == r.p_r and (r.p_r > r.r_true) == padded
    by_index = {r.label: (r.n, r.p_r - r.overhead) for r in label_count_index(index, labels, keys).collect()}
    assert by_index == {**{k: (n, n) for k, n in counts.items()}, "Nobody": (0, 0)}
    names = {r.label for r in graph.nodes.select("label").distinct().collect()}
    for r in label_count_scan(labels, graph.nodes, store, keys).collect():
        n = counts[r.label] if r.label in names else 0
        assert (r.n, r.p_r, r.overhead) == (n, 2 * n, n)


def test_degrees_agree(spark, keys, world):
    _, graph, store, _, _ = world
    ids = graph.nodes.select("id").unionByName(spark.createDataFrame([(777,)], "id bigint"))
    plain = node_degree_sample(ids, graph.nodes, graph.edges)
    padded = node_degree_padded(ids, store, keys)
    assert rows(padded.select("id", "degree", "sample")) == rows(plain)
    for r in padded.collect():
        assert (r.p_r, r.scanned, r.overhead) == (2 * r.degree, 2 * r.degree, max(2 * r.degree - 1, 0))


def test_reads_of_one_size_class_look_alike(spark, keys, world):
    """The fetched set is written before anything filters it, and its size follows the padded size only."""
    _, graph, store, _, _ = world
    ids = [r.id for r in graph.nodes.orderBy("id").collect()]
    for r in (6, 7, 8, 9, 10):
        requests = spark.createDataFrame([("q", i) for i in ids[:r]], "key string, node_id bigint")
        pads = pad_table(requests.groupBy("key").agg(F.count(F.lit(1)).alias("r")), "key")
        fetched = lookup_padded(requests, pads, "key", store, ["ct"])
        assert fetched.columns == ["key", "node_id", "ct"]
        assert fetched.count() == r + 2 == pads.first()["p_r"]


def test_index_slots_do_not_tell_kinds_apart(spark, keys, world):
    _, graph, _, index, _ = world
    opened = index.entries.select("token", "slot", F.get_json_object(unseal(F.col("ct"), keys.index), "$.kind").alias("kind"))
    per = opened.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"),
        F.countDistinct("slot").alias("slots"), F.avg(F.when(F.col("kind") == "d", F.col("slot"))).alias("mean"),
    )
    sizes = {r.token: r.p_r for r in index.sizes.collect()}
    for r in per.collect():
        assert r.n == r.slots == sizes[r.token] and (r.lo, r.hi) == (0, r.n - 1)
    large = per.filter("n > 40").collect()
    assert large and all(r["mean"] < r.n * 0.85 for r in large)
    assert index.entries.select(F.length("ct")).distinct().count() == 1
