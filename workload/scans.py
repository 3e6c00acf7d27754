"""Sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgraph.operators.adjacency import LIST_ROWS
from veilgraph.operators.graph import derive_nodes, drop_self_loops, normalise_undirected
from veilgraph.operators.index import LabelIndex, filter_kind, index_lookup, label_histogram, label_index_rows, merge_segments
from veilgraph.operators.lookup import adjacency_or_empty
from veilgraph.operators.protect import (
    EDGE_RECORD,
    NODE_RECORD,
    protect_edges,
   
    open_lists,
    open_rows,
    seal_store,
)
from veilgraph.plans.ingest import append_protected, read_protected, write_protected
from veilgraph.plans.report import filter_runs
from veilgraph.runtime import new_path, scratch
from veilgraph.sources.edge_list import scan_edge_list
from veilgraph.sources.snapshot import scan_edge_snapshot, scan_node_snapshot
from veilgraph.sources.store import replace_dataset, with_endpoints, write_labelled_snapshot
from veilgraph.sources.trade import trade_pairs
from workload.registry import graph_sql, query, spread
from workload.runs import RUNS_SQL, run_log


def _lines(w):
    """An edge list with the irregularities the loaders must handle, one line per line item."""
    u = (F.lit(2000000000) + F.col("l_suppkey")).cast("string")
    v = (F.lit(3000000000) + F.col("l_partkey")).cast("string")
    n = F.col("l_linenumber")
    line = (
        F.when(n == 2, F.concat(v, F.lit("\t"), u))
        .when(n == 3, F.concat(F.lit("  "), u, F.lit("   "), v, F.lit(" ")))
        .when(n == 4, F.concat(u, F.lit(" "), v, F.lit(" 99")))
        .when(n == 5, u)
        .when(n == 6, F.concat(F.lit("x"), u, F.lit(" "), v))
        .when((n == 7) & (F.col("l_returnflag") == "N"), F.lit(""))
        .when(n == 7, F.concat(F.lit("# "), u, F.lit(" "), v))
        .otherwise(F.concat(u, F.lit(" "), v))
    )
    return w.table("lineitem").select(line.alias("value"))


_ITEM = "SELECT 2000000000 + l_suppkey a, 3000000000 + l_partkey b, l_linenumber n FROM lineitem"
_PARSED = "SELECT 'edge' AS kind, a AS u, b AS v, NULL AS reason FROM item WHERE n IN (1, 3{four}) " \
    "UNION ALL SELECT 'edge', b, a, NULL FROM item WHERE n = 2"
_COUNTED = "SELECT kind, u, v, reason, count(*) AS n FROM ({rows}) GROUP BY ALL"
_REJECT = " UNION ALL SELECT 'reject', NULL, NULL, '{reason}' FROM item WHERE n IN ({lines})"
STRICT_SQL = f"WITH item AS ({_ITEM}) " + _COUNTED.format(
    rows=_PARSED.format(four="") + _REJECT.format(reason="token count", lines="4, 5")
    + _REJECT.format(reason="not an integer", lines="6")
)
LENIENT_SQL = f"WITH item AS ({_ITEM}) " + _COUNTED.format(
    rows=_PARSED.format(four=", 4") + _REJECT.format(reason="not an integer", lines="6")
)


def _scan(w, mode, compression):
    path = new_path(w.spark, "edge-list")
    _lines(w).write.text(path, compression=compression)
    found = scan_edge_list(w.spark, path, mode)
    null = F.lit(None)
    rows = found.edges.select(F.lit("edge").alias("kind"), "u", "v", null.cast("string").alias("reason")).unionByName(
        found.rejects.select(
            F.lit("reject").alias("kind"), null.cast("bigint").alias("u"), null.cast("bigint").alias("v"), "reason"
        )
    )
    return rows.groupBy("kind", "u", "v", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("scan_edge_list_strict", STRICT_SQL)
def scan_edge_list_strict(w):
    return _scan(w, "strict", "none")


@query("scan_edge_list_lenient", LENIENT_SQL)
def scan_edge_list_lenient(w):
    return _scan(w, "lenient", "none")


@query("scan_edge_list_gz", LENIENT_SQL)
def scan_edge_list_gz(w):
    return _scan(w, "lenient", "gzip")


def node_snapshot_rows(w):
    """The next state of the nodes, as another system writes it."""
    kept = w.nodes.filter(F.col("id") % 101 != 7).select(
        F.col("id").cast("string").alias("node_id"),
        F.when(F.col("id") % 97 == 5, F.lit(None)).when(F.col("id") % 53 == 3, F.lit("Inactive")).otherwise(
            F.col("label")
        ).alias("label"),
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("blob"), F.col("id").cast("string")).cast("binary")).alias("adj_ct"),
    )
    odd = w.nodes.filter(F.col("id") % 211 == 1).select(
        F.concat(F.lit("x"), F.col("id").cast("string")).alias("node_id"), "label",
        F.lit(None).cast("binary").alias("adj_ct"),
    )
    return kept.unionByName(odd)


@query("scan_node_snapshot", graph_sql("""
SELECT id, CASE WHEN id % 97 = 5 OR id % 53 = 3 THEN 'Inactive' ELSE label END AS label,
  CASE WHEN id % 5 = 0 THEN 'blob' || id ELSE '' END AS adj FROM nodes WHERE id % 101 <> 7"""))
def scan_node_snapshot_query(w):
    path = new_path(w.spark, "snapshot")
    node_snapshot_rows(w).write.parquet(path)
    rows = scan_node_snapshot(w.spark, path)
    return rows.select("id", "label", F.col("adj_ct").cast("string").alias("adj"))


@query("scan_edge_snapshot", graph_sql("""
SELECT u, v, CASE WHEN (u + v) % 3 = 0 THEN 'REPLY' WHEN (u + v) % 7 = 0 THEN 'SEND' ELSE label END AS label FROM edges"""))
def scan_edge_snapshot_query(w):
    total = F.col("u") + F.col("v")
    turned = total % 2 == 0
    first = w.edges.select(
        F.when(turned, F.col("v")).otherwise(F.col("u")).cast("string").alias("src"),
        F.when(turned, F.col("u")).otherwise(F.col("v")).cast("string").alias("dst"),
        F.when(total % 7 == 0, F.lit(None)).otherwise(F.col("label")).alias("edge_label"),
        F.lit(1).alias("seq"),
    )
    again = w.edges.filter(total % 3 == 0).select(
        F.col("v").cast("string").alias("src"), F.col("u").cast("string").alias("dst"),
        F.lit("REPLY").alias("edge_label"), F.lit(2).alias("seq"),
    )
    odd = w.nodes.select(
        F.concat(F.lit("x"), F.col("id").cast("string")).alias("src"), F.col("id").cast("string").alias("dst"),
        F.col("label").alias("edge_label"), F.lit(3).alias("seq"),
    )
    path = new_path(w.spark, "snapshot")
    first.unionByName(again).unionByName(odd).write.parquet(path)
    return scan_edge_snapshot(w.spark, path, "seq")


@query("sink_protected_nodes", graph_sql("""
SELECT d AS dataset_id, id, label, degree FROM nodes, (SELECT unnest(['trade', 'twin']) d)"""))
def sink_protected_nodes(w):
    path = new_path(w.spark, "sink")
    store = w.sealed("nodes", "adjacency")
    rows = adjacency_or_empty(store.nodes.drop("pos"), store.adjacency)
    replace_dataset(rows, path, "trade")
    replace_dataset(rows, path, "twin")
    replace_dataset(rows, path, "trade")  # the whole dataset again; the twin stays
    back = w.spark.read.parquet(path)
    nodes = open_rows(back.filter("piece = 0"), w.keys, "ct", NODE_RECORD)
    lists = open_lists(back.filter("length(adj_ct) > 0"), w.keys)
    sizes = lists.groupBy("dataset_id", "node_id").agg(F.sum(F.size("nbrs")).alias("degree"))
    return nodes.join(sizes, ["dataset_id", "node_id"]).select(
        "dataset_id", F.col("record.id").alias("id"), F.col("record.label").alias("label"), "degree"
    )


@query("sink_protected_edges", graph_sql("""
SELECT 'trade' AS dataset_id, u AS src, v AS dst, label FROM edges WHERE u % 101 <> 7 AND v % 101 <> 7"""))
def sink_protected_edges(w):
    alive = w.nodes.filter(F.col("id") % 101 != 7)
    path = new_path(w.spark, "sink")
    kept = with_endpoints(w.edges.select("u", "v", "label"), alive, "u", "v")
    replace_dataset(protect_edges(kept, w.keys), path, "trade")
    back = open_rows(w.spark.read.parquet(path), w.keys, "ct", EDGE_RECORD)
    return back.select("dataset_id", "record.src", "record.dst", "record.label")


@query("sink_labelled_snapshot", graph_sql("""
SELECT 'v' AS kind, id AS a, NULL::BIGINT AS b, label FROM nodes
UNION ALL SELECT 'e', u, v, label FROM edges"""))
def sink_labelled_snapshot(w):
    path = new_path(w.spark, "snapshot")
    # Pairs in either direction, as a store returns them.
    turned = (F.col("u") + F.col("v")) % 2 == 0
    given = w.edges.select(
        F.when(turned, F.col("v")).otherwise(F.col("u")).alias("u"),
        F.when(turned, F.col("u")).otherwise(F.col("v")).alias("v"),
        "label",
    )
    write_labelled_snapshot(path, w.nodes, given, w.sealed("adjacency").adjacency)
    nodes = scan_node_snapshot(w.spark, f"{path}/nodes")
    edges = scan_edge_snapshot(w.spark, f"{path}/edges")
    return nodes.select(
        F.lit("v").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), "label"
    ).unionByName(edges.select(F.lit("e").alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), "label"))


@query("append_node", graph_sql("""
SELECT id, label FROM nodes UNION ALL
SELECT id, 'Inactive' FROM (SELECT DISTINCT 9000000000 + user_id AS id FROM events
  UNION SELECT 3000000000 + p_partkey FROM part) WHERE id NOT IN (SELECT id FROM nodes)"""))
def append_node(w):
    """Into a stored dataset that is read back, and read back again with what was appended."""
    store, _ = _appended(w)
    return open_rows(store.nodes.select("ct"), w.keys, "ct", NODE_RECORD).select("record.id", "record.label")


def _appended(w):
    path = new_path(w.spark, "appended")
    graph = w.graph  # built outside of the scope
    with scratch(w.spark):  # sealed in the dataset, and not copied to it
        index = LabelIndex(*label_index_rows(label_histogram(graph.nodes, graph.edges), w.keys))
        write_protected(seal_store(graph, w.keys), index, path, "trade")
    users = w.table("events").select((F.lit(9000000000) + F.col("user_id")).alias("id"))
    parts = w.table("part").select((F.lit(3000000000) + F.col("p_partkey")).alias("id"))
    append_protected(*read_protected(w.spark, path, "trade"), users.unionByName(parts), w.keys)
    return read_protected(w.spark, path, "trade")


@query("append_node_index", graph_sql("""
SELECT id, count(*) AS n FROM (SELECT id FROM nodes WHERE label = 'Inactive' UNION ALL
  SELECT id FROM (SELECT DISTINCT 9000000000 + user_id AS id FROM events
    UNION SELECT 3000000000 + p_partkey FROM part) WHERE id NOT IN (SELECT id FROM nodes)) GROUP BY id"""))
def append_node_index(w):
    """The label of appended nodes, looked up in the index that was appended to, its segments merged."""
    _, index = _appended(w)
    lowest = w.spark.createDataFrame([("Inactive",)], "label string")
    found = index_lookup(merge_segments(index, lowest, w.keys), lowest, w.keys)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("drop_self_loops", graph_sql("SELECT u, v, count(*) AS n FROM raw WHERE u <> v GROUP BY u, v"))
def drop_self_loops_query(w):
    return drop_self_loops(trade_pairs(w.spark, w.sf_dir)).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


@query("normalise_undirected", graph_sql("SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM raw"))
def normalise_undirected_query(w):
    return normalise_undirected(trade_pairs(w.spark, w.sf_dir))


@query("derive_nodes", graph_sql("SELECT id FROM nodes"))
def derive_nodes_query(w):
    return derive_nodes(w.edges)


@query("filter_index_kind", graph_sql("SELECT label, id, u, v FROM hist"))
def filter_index_kind(w):
    histogram = label_histogram(w.nodes, w.edges)
    kinds = filter_kind(histogram, "v").unionByName(filter_kind(histogram, "e"))
    return kinds.select("label", "id", "u", "v")


@query("filter_runs", f"{RUNS_SQL} SELECT event_id, label, scheme, k, depth, t_total_ms FROM runs "
       "WHERE scheme = 'padded' AND k IN (2, 4) AND depth = 1")
def filter_runs_query(w):
    return filter_runs(run_log(w), scheme="padded", k=[2, 4], depth=1)


@query("adjacency_or_empty", graph_sql(f"""
SELECT id AS node_id, piece, max(has)::BOOLEAN AS has_list FROM (
  SELECT id, ({spread('nbr')}) % greatest(1, CAST(ceil(degree / {LIST_ROWS}.0::DOUBLE) AS BIGINT)) AS piece, 1 AS has FROM sym
  UNION ALL SELECT id, unnest(range(0, greatest(1, CAST(ceil(degree / {LIST_ROWS}.0::DOUBLE) AS BIGINT)))), 0 FROM nodes
  UNION ALL SELECT 9000000000 + c_custkey, 0, 0 FROM customer) GROUP BY ALL"""))
def adjacency_or_empty_query(w):
    lonely = w.table("customer").select(
        (F.lit(9000000000) + F.col("c_custkey")).alias("node_id"), F.lit(1).cast("bigint").alias("pieces")
    )
    store = w.sealed("nodes", "adjacency")
    rows = adjacency_or_empty(store.nodes.select("node_id", "pieces").unionByName(lonely), store.adjacency)
    return rows.select("node_id", "piece", (F.length("adj_ct") > 0).alias("has_list"))
