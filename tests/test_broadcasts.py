"""What the driver collects for a broadcast is bounded by rows in memory, not by the bytes of a file or a planner's guess."""

import re

from pyspark.sql import functions as F

from conftest import LOW_CUTOFFS, pairs_of, rows
from veilgraph import runtime
from veilgraph.operators import padding
from veilgraph.operators.graph import build_graph
from veilgraph.operators.padding import decoy_window, few_decoy_windows
from veilgraph.operators.protect import build_store
from veilgraph.plans import labels
from veilgraph.runtime import save


def test_a_short_file_of_many_ids_is_not_broadcast(spark, tmp_path):
    session = spark.newSession()
    ids = F.col("id") * 7919 + 5_000_000_000
    session.range(600_000).select(ids.alias("id"), F.lit("Inactive").alias("label")).write.parquet(str(tmp_path / "nodes"), compression="zstd")
    session.range(1_200_000).select(ids.alias("id")).write.parquet(str(tmp_path / "long"), compression="zstd")
    runtime.fit_partitions(session, str(tmp_path / "nodes"))
    nodes, long = (session.read.parquet(str(tmp_path / name)) for name in ("nodes", "long"))
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "4m")
    joined = long.join(nodes.select("id"), "id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 600_000


def test_the_users_estimate_stays(spark, tmp_path):
    session = spark.newSession()
    session.conf.set("spark.sql.sources.fileCompressionFactor", "3.0")
    (tmp_path / "table.parquet").write_bytes(b"x")
    runtime.fit_partitions(session, str(tmp_path / "table.parquet"))
    assert session.conf.get("spark.sql.sources.fileCompressionFactor") == "3.0"


def _pads(spark, dummies):
    data = [(f"k{i}", 5, 5 + d, d) for i, d in enumerate(dummies)]
    return save(spark.createDataFrame(data, "key string, r bigint, p_r bigint, dummies bigint"), "pads")


def test_windows_are_broadcast_by_block(spark, monkeypatch):
    total = 60_000
    store = spark.range(total).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("node_id"))
    pads = _pads(spark, [0, 1, 4095, 4096, 50_000, 59_999, 3])
    low, high, reads = pads.agg(*padding.window_bounds(total), F.sum("p_r")).first()
    wanted = decoy_window(pads, "key", store, total).select("key", "node_id")
    real, sent = padding.F.broadcast, []
    monkeypatch.setattr(padding.F, "broadcast", lambda side: sent.append(side.count()) or real(side))
    for block, hubs in ((4096, 50_000), (7, 20)):  # few rows also for long windows in short blocks
        monkeypatch.setattr(padding, "WINDOW_BLOCK", block)
        monkeypatch.setattr(padding, "MAX_HUBS", hubs)
        found = few_decoy_windows(pads, "key", store, total, low, high, reads).select("key", "node_id")
        assert rows(found) == rows(wanted)
        assert found.count() == 118_194
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("BroadcastExchange") > 0, plan
    assert len(sent) == 2 and max(sent) <= 50


def test_a_store_shorter_than_its_windows(spark):
    store = spark.range(3).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("node_id"))
    pads = _pads(spark, [9, 2])
    low, high, reads = pads.agg(*padding.window_bounds(3), F.sum("p_r")).first()
    found = few_decoy_windows(pads, "key", store, 3, low, high, reads).select("key", "node_id")
    assert rows(found) == rows(decoy_window(pads, "key", store, 3).select("key", "node_id"))


def test_lists_read_again_are_decrypted_and_not_parsed(spark, keys, monkeypatch):
    star = [(0, i) for i in range(1, 41)] + [(1, 2), (2, 3)]
    graph = build_graph(pairs_of(spark, star), LOW_CUTOFFS)
    store = build_store(graph, keys, list_rows=16)
    real, parsed = labels.open_lists, []
    monkeypatch.setattr(labels, "open_lists", lambda blobs, keys: parsed.append(blobs.count()) or real(blobs, keys))
    found = labels.node_degree_padded(graph.nodes.select("id"), store, keys)
    assert {r.id: (r.degree, r.p_r, r.scanned) for r in found.collect()} == {
        r.id: (r.degree, 2 * r.degree, 2 * r.degree) for r in graph.nodes.collect()
    }
    lists = store.adjacency.count()
    # Round 0 reads the pieces below the doubled degree, which are all of them.
    assert parsed == [lists, lists]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"count\(.*aesDecrypt.*\) AS scanned", plan), plan
