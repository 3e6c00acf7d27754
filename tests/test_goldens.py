"""The golden figures of FIXTURES F2 and F4, on the documented trade graph.

That graph pairs up all suppliers of a nation, so it serves as a small fixture
only; the registered queries run on the linear graph of ``sources.trade``.
"""

import pytest
from pyspark.sql import functions as F

from veilgraph.operators.graph import build_graph, graph_stats, pick_by_degree_rank
from veilgraph.plans.pattern import match_pattern_batch, pattern_table
from veilgraph.plans.sync import sync_summary
from veilgraph.plans.traverse import bfs_plain, neighbour_table

F2 = """
WITH raw AS (
  SELECT 1000000000+o_custkey u, 2000000000+l_suppkey v FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE l_quantity>=49
  UNION ALL SELECT 2000000000+l_suppkey, 3000000000+l_partkey FROM lineitem
  UNION ALL SELECT 4000000000+bigint(c_nationkey), 1000000000+c_custkey FROM customer
  UNION ALL SELECT 4000000000+bigint(s_nationkey), 2000000000+s_suppkey FROM supplier
  UNION ALL SELECT 2000000000+a.s_suppkey, 2000000000+b.s_suppkey FROM supplier a JOIN supplier b ON a.s_nationkey=b.s_nationkey
  UNION ALL SELECT 4000000000+bigint(a.n_nationkey), 4000000000+bigint(b.n_nationkey) FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey
  UNION ALL SELECT 1000000000+o_custkey, 5000000000+o_orderkey FROM orders)
SELECT u, v FROM raw"""

GOLDEN = {
    "0.001": dict(
        edges=3845, nodes=1885, max_degree=226, avg_degree=4.08,
        labels={"Manager": 10, "External": 371, "Inactive": 1504, "SEND": 1721, "BROADCAST": 1915, "INTERNAL": 209},
        patterns=[0, 0, 0, 230],
        starts={"high": (2000000003, 226), "mid": (5000000086, 1), "low": (5000001499, 1)},
        visited={"high": (227, 584, 729), "mid": (2, 7, 16), "low": (2, 13, 264)},
    ),
    "0.01": dict(
        edges=70936, nodes=18625, max_degree=595, avg_degree=7.62,
        labels={"Executive": 99, "Manager": 1, "Employee": 24, "External": 3470, "Inactive": 15031,
                "SEND": 18713, "REPLY": 206, "BROADCAST": 51831, "INTERNAL": 186},
        patterns=[5, 1, 92, 25],
        starts={"high": (2000000098, 595), "mid": (5000001031, 1), "low": (5000014999, 1)},
        visited={"high": (596, 2363, 5700), "mid": (2, 20, 1345), "low": (2, 23, 1787)},
    ),
}


@pytest.fixture(scope="module", params=list(GOLDEN))
def golden(request, spark):
    for name in ("lineitem", "orders", "customer", "supplier", "nation"):
        spark.read.parquet(f"/root/testdata/sf{request.param}/{name}.parquet").createOrReplaceTempView(name)
    return request.param, GOLDEN[request.param], build_graph(spark.sql(F2))


def test_sizes_and_labels(golden):
    _, want, graph = golden
    stats = {r.stat: r.value for r in graph_stats(graph.nodes, graph.edges).collect()}
    assert [stats[s] for s in ("nodes", "edges", "max_degree", "avg_degree")] == [
        want["nodes"], want["edges"], want["max_degree"], want["avg_degree"]
    ]
    assert {s.removeprefix("label:"): v for s, v in stats.items() if s.startswith("label:")} == want["labels"]


def test_patterns(spark, golden):
    _, want, graph = golden
    patterns = pattern_table(spark)
    found = {r.pattern: r.matches for r in match_pattern_batch(graph, patterns).collect()}
    assert [found[r.pattern] for r in patterns.collect()] == want["patterns"]


def test_traversal(golden):
    _, want, graph = golden
    starts = pick_by_degree_rank(graph.nodes)
    picked = {r["class"]: (r.id, r.degree) for r in starts.collect()}
    assert picked == want["starts"]
    sizes = bfs_plain(starts.select(F.col("id").alias("seed")), graph.nodes, neighbour_table(graph))
    visited = {(r.seed, r.depth): r.visited for r in sizes.collect()}
    for name, (seed, _) in picked.items():
        assert tuple(visited[(seed, d)] for d in (1, 2, 3)) == want["visited"][name]


def test_snapshot_counters(spark, golden):
    sf, _, graph = golden
    if sf != "0.01":
        pytest.skip("the golden counters are for sf0.01")
    alive = F.col("id") % 101 != 7
    nodes = graph.nodes.filter(alive).select(
        "id", F.when(F.col("id") % 53 == 3, F.lit("Inactive")).otherwise(F.col("label")).alias("label")
    )
    first = nodes.agg(F.min("id")).first()[0]
    assert first == 1000000000
    new = spark.range(9000000000, 9000000010).select("id", F.lit("Inactive").alias("label"))
    kept = graph.edges.filter((F.col("u") % 101 != 7) & (F.col("v") % 101 != 7) & ((F.col("u") + F.col("v")) % 17 != 5))
    edges = kept.select("u", "v", "label").unionByName(
        new.select(F.lit(first).alias("u"), F.col("id").alias("v"), F.lit("SEND").alias("label"))
    )
    found = sync_summary(graph.nodes, graph.edges, nodes.unionByName(new), edges).first().asDict()
    assert found == dict(
        nodes_added=10, nodes_removed=183, nodes_updated=67, edges_added=10, edges_removed=5475,
        edges_relabelled=0, changed=True,
    )
