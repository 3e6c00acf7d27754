"""An edge-list file becomes a protected graph that another session can query."""

import pytest
from pyspark.sql import functions as F

from conftest import LOW_CUTOFFS, rows
from veilgraph.operators.index import index_lookup
from veilgraph.operators.protect import open_lists
from veilgraph.plans.ingest import ingest, read_protected, write_protected
from veilgraph.plans.traverse import bfs_levels

TEXT = "# a wheel\n" + "".join(f"0 {i}\n{i} {i % 8 + 1}\n" for i in range(1, 9)) + "8 9\nbad line\n"


def test_ingest_write_read(spark, keys, tmp_path):
    (tmp_path / "e.txt").write_text(TEXT)
    found = ingest(spark, str(tmp_path / "e.txt"), keys, cutoffs=LOW_CUTOFFS)
    assert rows(found.rejects) == [("bad line", "not an integer")]
    assert (found.store.n_nodes, found.store.n_edges) == (10, 17)
    path = str(tmp_path / "store")
    write_protected(found.store, found.index, path, "wheel")
    write_protected(found.store, found.index, path, "other")
    store, index = read_protected(spark, path, "wheel")
    assert (store.n_nodes, store.n_edges) == (10, 17)
    labels = found.graph.nodes.select("label").distinct()
    by_index = index_lookup(index, labels, keys).select("label", "id")
    assert rows(by_index) == rows(found.graph.nodes.select("label", "id"))
    levels = bfs_levels(spark.createDataFrame([(9,)], "seed bigint"), store, keys).orderBy("depth").collect()
    assert [r.visited for r in levels] == [2, 5, 10]


def test_a_list_names_its_owner(spark, keys, tmp_path):
    """A blob filed under another node still says whose list it is."""
    (tmp_path / "e.txt").write_text("1 2\n2 3\n")
    found = ingest(spark, str(tmp_path / "e.txt"), keys)
    moved = found.store.adjacency.withColumn("node_id", F.col("node_id") + 100)
    assert rows(open_lists(moved, keys).select("node_id").distinct()) == [(1,), (2,), (3,)]


def test_decoys_are_decrypted_like_the_rest(spark, keys, tmp_path, capsys):
    """The filter for wanted owners stays above the decryption."""
    (tmp_path / "e.txt").write_text("1 2\n2 3\n")
    found = ingest(spark, str(tmp_path / "e.txt"), keys)
    wanted = spark.createDataFrame([(1, 0)], "node_id bigint, piece bigint")
    open_lists(found.store.adjacency, keys).join(wanted, ["node_id", "piece"], "left_semi").explain()
    plan = capsys.readouterr().out
    assert plan.index("Join") < plan.index("aesDecrypt")


def test_empty_input(spark, keys, tmp_path):
    (tmp_path / "e.txt").write_text("# nothing\n")
    with pytest.raises(ValueError):
        ingest(spark, str(tmp_path / "e.txt"), keys)
