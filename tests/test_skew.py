"""One key with most of the rows: results stay whole and no path depends on the key's size."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import LOW_CUTOFFS, pairs_of, rows
from veilgraph.operators import skew
from veilgraph.operators.adjacency import build_adjacency, neighbours, owner_pieces, smallest_neighbours
from veilgraph.operators.graph import attach_endpoint_labels, build_graph, pick_by_degree_rank
from veilgraph.operators.lookup import lookup_plain
from veilgraph.operators.padding import decoy_copies, dummy_entries, pad_table
from veilgraph.operators.skew import Dimension, attach, filter_by_keys, hub_bound, repeat_rows, with_positions
from veilgraph.runtime import save

# Node 0 has more than a third of all edge ends.
STAR = [(0, i) for i in range(1, 401)] + [(i, i + 1) for i in range(1, 200)] + [(7, i) for i in range(300, 360)]


@pytest.fixture(scope="module")
def star(spark):
    return build_graph(pairs_of(spark, STAR), LOW_CUTOFFS, hub_rows=50)


def test_hub_bound_keeps_the_hub_table_short():
    assert hub_bound(1000) == skew.HUB_ROWS
    assert hub_bound(10**12) * skew.MAX_HUBS >= 10**12


def test_hubs_are_found_and_bounded(star):
    dim = Dimension.of(star.nodes, "id", "degree", hub_rows=50)
    assert rows(dim.hubs.select("id")) == [(0,), (7,)]
    assert Dimension.of(star.nodes, "id", "degree").hubs is None


def test_attach_is_the_same_with_and_without_hubs(spark, star):
    edges = star.edges.select("u", "v")
    plain = attach_endpoint_labels(edges, star.nodes, Dimension(star.nodes, "id", None))
    split = attach_endpoint_labels(edges, star.nodes, Dimension.of(star.nodes, "id", "degree", hub_rows=50))
    assert rows(plain) == rows(split)
    assert split.count() == edges.count()


def test_attach_scatter_may_hit_a_real_key(spark):
    facts = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 99), (3, 98)], "k bigint, n bigint")
    table = spark.createDataFrame([(1, "hub", 30), (2, "two", 1)], "id bigint, name string, w bigint")
    dim = Dimension.of(table, "id", "w", hub_rows=10)
    found = attach(facts, "k", dim, {"name": "name"}, F.lit(2).cast("bigint"))
    assert rows(found.groupBy("k", "name").count()) == [(1, "hub", 30), (2, "two", 1), (3, None, 1)]


def test_lists_come_in_pieces(star):
    lists = build_adjacency(star.edges, list_rows=16)
    sizes = {(r.id, r.piece): r.n for r in lists.select("id", "piece", F.size("nbrs").alias("n")).collect()}
    hub = [n for (i, _), n in sizes.items() if i == 0]
    assert sum(hub) == 400 and len(hub) == 25 and max(hub) < 48
    joined = neighbours(star.edges, 16).join(owner_pieces(star.nodes, star.nodes, 16), ["id", "piece"])
    assert joined.count() == 2 * star.edges.count()


def test_first_neighbours_limit_before_the_shuffle(star, capsys):
    top = smallest_neighbours(neighbours(star.edges), 10)
    assert [r.nbr for r in top.filter("id = 0").orderBy("place").collect()] == list(range(1, 11))
    top.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_positions_are_dense(spark):
    values = list(range(5000))
    random.Random(3).shuffle(values)
    found = with_positions(spark.createDataFrame([(v,) for v in values], "id bigint").repartition(7), ["id"])
    assert sorted((r.id, r.pos) for r in found.collect()) == [(v, v) for v in range(5000)]


def test_positions_within_one_hot_group(spark):
    data = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(5)] + [("one", 0)]
    table = spark.createDataFrame(data, "g string, id bigint").repartition(9)
    found = with_positions(table, [F.desc("id")], within=["g"], size="n").collect()
    sizes = {"hot": 3000, "cold": 5, "one": 1}
    assert len(found) == len(data)
    assert all(r.pos == sizes[r.g] - 1 - r.id and r.n == sizes[r.g] for r in found)


def test_repeats_cross_block_borders(spark, monkeypatch):
    monkeypatch.setattr(skew, "REPEAT_BLOCK", 7)
    table = spark.createDataFrame([("a", 0), ("b", 1), ("c", 7), ("d", 50)], "k string, n bigint")
    found = repeat_rows(table, F.col("n"), ["k"])
    wanted = [(k, i) for k, n in (("a", 0), ("b", 1), ("c", 7), ("d", 50)) for i in range(n)]
    assert sorted((r.k, r.i) for r in found.collect()) == wanted


@pytest.mark.parametrize("bound", [0, 50_000])
def test_filter_by_keys_short_and_long_lists(spark, monkeypatch, bound):
    monkeypatch.setattr(skew, "MAX_HUBS", bound)
    table = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k bigint, n bigint")
    wanted = save(spark.createDataFrame([(1,), (6,)], "k bigint"), "t")
    assert filter_by_keys(table, "k", wanted).count() == 201
    assert filter_by_keys(table, "k", wanted, keep=False).count() == 99


def test_lookup_repeats_and_misses(spark):
    ids = spark.createDataFrame([(1,)] * 100 + [(2,)] * 3 + [(9,)], "node_id bigint")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "node_id bigint, t string")
    assert rows(lookup_plain(ids, table).groupBy("node_id", "t").count()) == [(1, "a", 100), (2, "b", 3)]


def test_copies_go_round(spark):
    batch = spark.createDataFrame([("x", i) for i in range(10)] + [("y", 1)], "k string, id bigint")
    found = decoy_copies(batch, "k", ["id"], lambda r: r * 2 + 3)
    counts = {(r.k, r.id): r["count"] for r in found.groupBy("k", "id").count().collect()}
    assert counts == {**{("x", i): 3 if i < 3 else 2 for i in range(10)}, ("y", 1): 5}
    assert found.filter("slot = 0").count() == 11


def test_dummies(spark):
    pads = pad_table(spark.createDataFrame([("a", 10), ("b", 0), ("c", 1)], "label string, r bigint"), "label")
    assert rows(dummy_entries(pads)) == [("a", 0, "__dummy_0__a"), ("a", 1, "__dummy_1__a"), ("c", 0, "__dummy_0__c")]


def test_picked_places(spark, star):
    order = sorted(((-r.degree, r.id) for r in star.nodes.collect()))
    wanted = {"high": order[0], "mid": order[len(order) // 4], "low": order[-1]}
    found = {r["class"]: (-r.degree, r.id) for r in pick_by_degree_rank(star.nodes).collect()}
    assert found == wanted
