"""A written store keeps its layout: another session joins bucket with bucket, prunes, and appends files only."""

import os
import random
from collections import deque
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from conftest import LOW_CUTOFFS, pairs_of, rows
from test_protected_files import files
from veilgraph.operators import lookup, skew
from veilgraph.operators.graph import build_graph
from veilgraph.operators.index import (
    append_to_index, build_label_index, fetch_entries, index_lookup, label_histogram, merge_segments, ready_to_merge,
)
from veilgraph.operators.lookup import lookup_padded
from veilgraph.operators.padding import pad_table
from veilgraph.operators.protect import NODE_RECORD, build_store, open_rows
from veilgraph.plans import pattern, traverse
from veilgraph.plans.ingest import append_protected, read_protected, write_protected
from veilgraph.plans.labels import label_query
from veilgraph.plans.pattern import match_pattern_batch, pattern_table
from veilgraph.plans.traverse import bfs_levels, bfs_plain, neighbour_table, reachable_pairs
from veilgraph.runtime import save, scratch

EDGES = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 28)] + [(40, 41)]


@pytest.fixture(scope="module")
def graph(spark):
    return build_graph(pairs_of(spark, EDGES), LOW_CUTOFFS)


@pytest.fixture(scope="module")
def written(spark, keys, graph, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    store = build_store(graph, keys, list_rows=4)
    index = build_label_index(label_histogram(graph.nodes, graph.edges), keys)
    write_protected(store, index, path, "wheel")
    return path


def stamps(folder):
    return {p: os.stat(p).st_mtime_ns for p in files(folder)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_another_session_reads_buckets(spark, keys, graph, written):
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    store, index = read_protected(other, written, "wheel")
    assert other.sql("SHOW TABLES").count() == 0
    asked = other.range(0, 30).select(F.col("id").alias("node_id"), (F.col("id") % 3).alias("piece"))
    for table, on in ((store.adjacency, ["node_id", "piece"]), (store.nodes, ["node_id"])):
        plan = plan_of(asked.join(table, on))
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1, plan
    few = plan_of(asked.join(store.nodes.filter(F.col("node_id").isin(3, 5)), "node_id"))
    assert "SelectedBucketsCount: 1 out of 4" in few or "SelectedBucketsCount: 2 out of 4" in few, few
    labels = other.createDataFrame([("External",)], "label string")
    lines = [x for x in plan_of(fetch_entries(index, labels, keys)).splitlines() if "PartitionFilters" in x]
    assert any("token" in x.split("PartitionFilters: ")[1].split("]")[0] for x in lines), lines
    seeds = other.createDataFrame([(40,), (1,)], "seed bigint")
    found = {(r.seed, r.depth): r.visited for r in bfs_levels(seeds, store, keys).collect()}
    plain = bfs_plain(seeds, graph.nodes, neighbour_table(graph)).collect()
    assert found == {(r.seed, r.depth): r.visited for r in plain if r.frontier_r}


def test_append_adds_files_only(spark, keys, graph, tmp_path):
    path = str(tmp_path)
    store, index = write_protected(
        build_store(graph, keys, list_rows=4), build_label_index(label_histogram(graph.nodes, graph.edges), keys), path, "a"
    )
    before = stamps(path)
    new = spark.createDataFrame([(0,), (900,), (901,), (901,)], "id bigint")
    lowest = spark.createDataFrame([("Inactive",)], "label string")
    was = {r.id for r in index_lookup(index, lowest, keys).collect()}
    append_protected(*read_protected(spark.newSession(), path, "a"), new, keys)
    append_protected(*read_protected(spark, path, "a"), new, keys)  # again: nothing
    after = stamps(path)
    assert before.items() <= after.items()
    added = [os.path.relpath(p, path).split(os.sep)[1] for p in after.keys() - before.keys()]
    assert added.count("index") == added.count("sizes") == 1 and set(added) == {"nodes", "node_places", "index", "sizes"}
    store, index = read_protected(spark, path, "a")
    assert store.n_nodes == graph.nodes.count() + 2
    assert sorted(r.pos for r in store.node_places.collect()) == list(range(store.n_nodes))
    opened = open_rows(store.nodes.filter("node_id >= 900"), keys, "ct", NODE_RECORD)
    assert rows(opened.select("record.id", "record.label")) == [(900, "Inactive"), (901, "Inactive")]
    found = index_lookup(index, lowest, keys).collect()
    assert {r.id for r in found} == was | {900, 901} and len(found) == len(was) + 2
    slots = index.entries.groupBy("token").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("top"))
    assert all(r.n == r.top + 1 for r in slots.collect())
    unmerged = rows(index_lookup(index, lowest, keys).drop("slot"))
    merged = merge_segments(index, lowest, keys)
    assert rows(index_lookup(merged, lowest, keys).drop("slot")) == unmerged
    assert ready_to_merge(merged, lowest, keys).count() == 0
    answers, _ = label_query(merged, lowest, store, keys)
    assert {r.id for r in answers.collect()} == was | {900, 901}


def test_many_segments_are_ready_to_merge(spark, keys):
    schema = "label string, kind string, id bigint, u bigint, v bigint"
    index = build_label_index(spark.createDataFrame([("a", "v", 1, None, None)], schema), keys)
    for k in range(2, 5):
        index = append_to_index(index, spark.createDataFrame([("a", "v", k, None, None), ("b", "v", k, None, None)], schema), keys)
    labels = spark.createDataFrame([("a",), ("none",)], "label string")
    assert [r.label for r in ready_to_merge(index, labels, keys).collect()] == ["a"]
    merged = merge_segments(index, labels, keys)
    both = spark.createDataFrame([("a",), ("b",)], "label string")
    assert sorted((r.label, r.id) for r in index_lookup(merged, both, keys).collect()) == (
        [("a", k) for k in range(1, 5)] + [("b", k) for k in range(2, 5)]
    )


@pytest.mark.parametrize("hubs,named", [(100_000, 1000), (4, 0)])
def test_padded_reads_agree_on_every_way(spark, keys, graph, monkeypatch, hubs, named):
    monkeypatch.setattr(lookup, "HUB_ROWS", hubs)
    monkeypatch.setattr(lookup, "NAMED_IDS", named)
    store = build_store(graph, keys, list_rows=4)
    requests = graph.nodes.filter("id < 10").select((F.col("id") % 3).cast("string").alias("key"), F.col("id").alias("node_id"))
    more = spark.range(0, 40).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.lit(0).cast("bigint").alias("node_id"))
    requests = requests.unionByName(more)
    pads = save(pad_table(requests.groupBy("key").agg(F.count(F.lit(1)).alias("r")), "key"), "pads")
    found = lookup_padded(requests, pads, "key", store, ["ct"])
    read = {r.key: r.n for r in found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert read == {r.key: r.p_r for r in pads.collect()}
    own = open_rows(found, keys, "ct", NODE_RECORD)
    assert own.filter(F.col("record.id") != F.col("node_id")).count() == 0
    assert rows(requests.join(found, ["key", "node_id"], "left_anti")) == []


def test_true_sizes_stay_off_the_disk(spark, keys, graph, shared_folder):
    import pyarrow.parquet as pq

    before = files(shared_folder)
    store = build_store(graph, keys, list_rows=4)
    index = build_label_index(label_histogram(graph.nodes, graph.edges), keys)
    labels = spark.createDataFrame([("External",), ("SEND",)], "label string")
    _, report = label_query(index, labels, store, keys)
    assert report.count() == 2
    found = files(shared_folder) - before
    assert found
    for path in found:
        names = set(pq.read_schema(path).names)
        assert not names & {"label", "kind", "id", "u", "v", "r", "dummies", "_asked", "_from"}, path
        assert not [n for n in names if n.startswith("n_")], path


def test_pairs_meet_half_way(spark, monkeypatch):
    r = random.Random(5)
    edges = {(min(p), max(p)) for p in ((r.randrange(60), r.randrange(60)) for _ in range(70)) if p[0] != p[1]}
    graph = build_graph(pairs_of(spark, sorted(edges)), LOW_CUTOFFS)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    asked = [(r.randrange(64), r.randrange(64)) for _ in range(200)] + [(3, 3), (63, 63)]

    def hops(a, b, most):
        if a == b:
            return 2 if near.get(a) and most >= 2 else None
        far, queue = {a: 0}, deque([a])
        while queue:
            x = queue.popleft()
            for y in near.get(x, ()):
                if y not in far:
                    far[y] = far[x] + 1
                    queue.append(y)
        return far[b] if b in far and b in near and far[b] <= most else None

    depths = []
    levels = traverse._levels
    monkeypatch.setattr(traverse, "_levels", lambda start, table, depth: depths.append(depth) or levels(start, table, depth))
    for most in (4, 3, 1):
        found = reachable_pairs(spark.createDataFrame(asked, "src bigint, dst bigint"), graph.nodes, neighbour_table(graph, 8), most)
        got = {(x.src, x.dst): (x.reachable, x.min_hops) for x in found.collect()}
        assert got == {(a, b): (hops(a, b, most) is not None, hops(a, b, most)) for a, b in asked}
    assert max(depths) == 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_long_side_and_a_hot_key(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "MAX_HUBS", 10)
    monkeypatch.setattr(skew, "HUB_ROWS", 50)
    many = spark.range(0, 3000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 60).alias("k"), "id")
    side = save(spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x")), "side")
    found = skew.join_small(many, side, ["k"], how)
    assert rows(found) == rows(many.join(side, ["k"], how))


def test_scratch_scopes_of_threads_are_their_own(spark):
    def work(k):
        with scratch(spark):
            table = save(spark.range(k * 10, k * 10 + 5), f"thread-{k}")
            other = save(spark.range(3), f"thread-other-{k}")
            return [r.id for r in table.crossJoin(other.select(F.col("id").alias("o")).limit(1)).orderBy("id").select(table.id).collect()]

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(work, range(8)))
    assert found == [list(range(k * 10, k * 10 + 5)) for k in range(8)]


def test_patterns_of_one_role_share_a_read(spark, keys, graph, monkeypatch):
    store = build_store(graph, keys, list_rows=4)
    fetched = []
    real = pattern.fetch_lists
    monkeypatch.setattr(pattern, "fetch_lists", lambda *a: fetched.append(real(*a)) or fetched[-1])
    names = [("External", e, d) for e in ("INTERNAL", "SEND", "REPLY") for d in ("External", "Employee", "Inactive", "Executive")]
    patterns = pattern_table(spark, names)
    pairs, report = pattern.match_pattern_protected(patterns, graph.nodes, store, keys)
    plain = {r.pattern: r.matches for r in match_pattern_batch(graph, patterns).collect()}
    assert {r.pattern: r.matches for r in report.collect()} == plain and sum(plain.values()) == pairs.count() > 0
    read = {r.blocks_fetched for r in report.collect()}
    assert len(fetched) == len(read) == 1
    lists = fetched[0].groupBy("node_id").agg(F.countDistinct("role").alias("n")).agg(F.max("n")).first()[0]
    assert lists == 1 and not {"label", "pattern"} & set(fetched[0].columns)
