"""Records and entries are sealed in few bytes and come back whole; records of older stores are read as well."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from veilgraph.functions.crypto import seal
from veilgraph.operators.index import build_label_index, label_histogram, open_entries
from veilgraph.operators.protect import EDGE_RECORD, NODE_RECORD, open_rows, protect_edges, protect_nodes, unprotect_rows

LABELS = ("BROADCAST", "two words", "", None, "a\nb", '{"x', "1 2", " é ")
FIRST = 1_000_000_000


@pytest.fixture(scope="module")
def edges(spark):
    given = [(FIRST + i, 2 * FIRST + i, label) for i, label in enumerate(LABELS)] + [
        (-5, 7, "A"), (None, 3, "B"), (4, None, None), (-(1 << 63), (1 << 63) - 1, "C"), (0, -1, "D"),
    ]
    return spark.createDataFrame(given, "u bigint, v bigint, label string")


def test_an_edge_record_is_short(edges, keys):
    sealed = protect_edges(edges.filter("label = 'BROADCAST'"), keys).select(F.length("ct"))
    assert sealed.first()[0] <= 12 + 16 + 2 * 7 + len("BROADCAST")


def test_edge_records_come_back(edges, keys):
    opened = open_rows(protect_edges(edges, keys), keys, "ct", EDGE_RECORD)
    wanted = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "label", F.lit(0).alias("attrs"))
    found = opened.select("record.src", "record.dst", "record.label", F.size("record.attrs").alias("attrs"))
    assert rows(found) == rows(wanted)


def test_node_records_come_back(edges, keys):
    nodes = edges.select(F.col("u").alias("id"), "label")
    found = unprotect_rows(protect_nodes(nodes, keys), keys, "ct", NODE_RECORD)
    assert rows(found.rows.select("record.id", "record.label")) == rows(nodes)
    assert found.rejected.isEmpty()


def test_records_of_older_stores_are_read(edges, keys):
    attrs = F.create_map(F.lit("k"), F.lit("w")).alias("attrs")
    record = F.to_json(F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), "label", attrs))
    old = edges.select(seal(record, keys.content).alias("ct"))
    found = open_rows(old, keys, "ct", EDGE_RECORD).select("record.src", "record.dst", "record.label", "record.attrs.k")
    assert rows(found) == rows(edges.withColumn("k", F.lit("w")))


def test_entries_are_short_of_one_length_and_come_back(spark, keys):
    nodes = spark.createDataFrame([(FIRST + i, "A b") for i in range(30)] + [(-3, ""), (FIRST, "é")], "id bigint, label string")
    edges = spark.createDataFrame(
        [(FIRST + i, 2 * FIRST + i, "REPLY") for i in range(40)] + [(None, 5, "REPLY"), (6, None, "REPLY")],
        "u bigint, v bigint, label string",
    )
    histogram = label_histogram(nodes, edges)
    index = build_label_index(histogram, keys)
    lengths = {r[0] for r in index.entries.select(F.length("ct")).collect()}
    assert len(lengths) == 1 and lengths.pop() <= 12 + 16 + len('{"kind":"e","u":,"v":}') + 2 * 10
    found = open_entries(index.entries, keys).select("kind", "id", "u", "v")
    assert rows(found) == rows(histogram.drop("label"))


def test_entries_of_large_numbers_are_short(spark, keys):
    edges = spark.createDataFrame([(FIRST + i, 5 * FIRST + i, "BROADCAST") for i in range(3000)], "u bigint, v bigint, label string")
    nodes = spark.createDataFrame([(k, "Inactive") for k in (0, 6 * FIRST, -(2**63), 2**63 - 1, None)], "id bigint, label string")
    for histogram, most in ((label_histogram(nodes.limit(0), edges), 34), (label_histogram(nodes, edges), 34)):
        index = build_label_index(histogram, keys)
        lengths = {r[0] for r in index.entries.select(F.length("ct")).collect()}
        assert len(lengths) == 1 and lengths.pop() <= 12 + 16 + most
        assert rows(open_entries(index.entries, keys).select("kind", "id", "u", "v")) == rows(histogram.drop("label"))


def test_entries_of_older_indexes_are_read(spark, keys):
    schema = "kind string, id bigint, u bigint, v bigint, pad string"
    data = [("v", 7, None, None, None), ("e", None, -3, 9, None), ("d", None, None, None, "__dummy_0__a")]
    old = spark.createDataFrame(data, schema)
    sealed = old.select(seal(F.to_json(F.struct(*old.columns)), keys.index).alias("ct"))
    assert rows(open_entries(sealed, keys)) == rows(old.filter("kind != 'd'").drop("pad"))
