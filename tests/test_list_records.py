"""A list blob holds each label once and comes back whole."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from veilgraph.functions.crypto import seal, unseal
from veilgraph.operators.adjacency import expand_lists
from veilgraph.operators.protect import open_lists, protect_adjacency


@pytest.fixture(scope="module")
def lists(spark):
    entries = [[(2, "A"), (3, None), (3, "B"), (5, "A")], [(7, "A"), (7, "A")], [], None]
    schema = "id bigint, piece bigint, nbrs array<struct<nbr:bigint,lbl:string>>"
    return spark.createDataFrame([(i, 0, e) for i, e in enumerate(entries)], schema)


def test_a_list_blob_names_each_label_once(lists, keys):
    text = protect_adjacency(lists, keys).select("node_id", unseal(F.col("adj_ct"), keys.content).alias("text"))
    found = {r.node_id: r.text for r in text.collect()}
    assert found[0].count('"A"') == 1 and found[1].count('"A"') == 1


def test_lists_come_back_whole_and_in_order(lists, keys):
    opened = open_lists(protect_adjacency(lists, keys), keys)
    wanted = lists.select(F.col("id").alias("node_id"), "piece", "nbrs").withColumn("nbrs", F.array_sort("nbrs"))
    assert rows(opened) == rows(wanted)
    assert expand_lists(opened).count() == 6


def test_blobs_of_older_stores_are_read(lists, keys):
    record = F.to_json(F.struct("id", "piece", "nbrs"))
    old = lists.select(F.col("id").alias("node_id"), "piece", seal(record, keys.content).alias("adj_ct"))
    assert rows(open_lists(old, keys)) == rows(open_lists(protect_adjacency(lists, keys), keys))
