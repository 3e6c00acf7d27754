"""Reports over runs, snapshot reconciliation and question logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.roles import EDGE_LABELS, NODE_LABELS
from veilgraph.operators.adjacency import build_adjacency
from veilgraph.operators.graph import pick_by_degree_rank
from veilgraph.operators.index import LabelIndex, label_histogram, label_index_rows, open_entries
from veilgraph.operators.protect import open_lists, protect_adjacency
from veilgraph.operators.skew import filter_by_keys
from veilgraph.plans.pattern import match_pattern_batch, match_pattern_protected, pattern_table
from veilgraph.plans.questions import (
    BFS,
    DEGREE,
    LABEL,
    PAIR,
    PATTERN,
    answer_questions,
    question_parameters,
    route_questions,
)
from veilgraph.plans.report import (
    align_schemes,
    filter_runs,
    max_k_row_per_label,
    mean_over_runs,
    order_by_category,
    order_by_metric,
    overall_mean_by_scheme,
)
from veilgraph.plans.counters import counters_of, graph_stats_of, update_counters
from veilgraph.plans.sync import (
    State,
    adjacency_changed,
    added,
    changes,
    edge_changes,
    rebuild_adjacency,
    relabelled,
    removed,
    sync_apply,
    sync_summary,
    touched_nodes,
    write_state,
)
from veilgraph.runtime import new_path, save, scratch
from veilgraph.sources.snapshot import clean_edge_snapshot, clean_node_snapshot
from veilgraph.sources.store import write_labelled_snapshot
from veilgraph.sources.trade import CUSTOMER, NATION, ORDER, PART, REGION, SUPPLIER, entity
from veilgraph.streaming.sync_stream import COUNTERS, initialise, start_sync, sync_history
from workload.graphs import _MATCHES, PATTERNS, pattern_sql
from workload.labelling import sizes
from workload.registry import graph_sql, level_ctes, pad, query
from workload.runs import RUNS_SQL, run_log

# --- run log -----------------------------------------------------------------------------


@query("mean_over_runs", f"{RUNS_SQL} SELECT label, k, scheme, round(avg(depth), 3) AS depth, "
       "round(avg(t_total_ms), 3) AS t_total_ms FROM runs GROUP BY label, k, scheme")
def mean_over_runs_query(w):
    return mean_over_runs(run_log(w).drop("event_id"), ["label", "k", "scheme"])


@query("overall_mean_by_scheme", f"""{RUNS_SQL}, means AS (
  SELECT scheme, avg(t_total_ms) m FROM runs WHERE label IN ('click', 'view') GROUP BY scheme
  UNION ALL SELECT scheme, avg(t_total_ms) FROM runs WHERE label IN ('signup', 'purchase', 'error') GROUP BY scheme)
SELECT scheme, round(avg(m), 2) AS value FROM means GROUP BY scheme""")
def overall_mean_by_scheme_query(w):
    runs = run_log(w)
    first = filter_runs(runs, label=["click", "view"])
    second = filter_runs(runs, label=["signup", "purchase", "error"])
    return overall_mean_by_scheme(first, second, "t_total_ms")


@query("pick_by_degree_rank", graph_sql("SELECT class, id, degree FROM starts"))
def pick_by_degree_rank_query(w):
    return pick_by_degree_rank(w.nodes)


@query("max_k_row_per_label", f"""{RUNS_SQL} SELECT label, scheme, k, t_total_ms, event_id, depth FROM (
  SELECT *, row_number() OVER (PARTITION BY label, scheme ORDER BY k DESC, t_total_ms DESC, event_id DESC) n FROM runs)
  WHERE n = 1""")
def max_k_row_per_label_query(w):
    return max_k_row_per_label(run_log(w), ["label", "scheme"], ["t_total_ms", "event_id"])


@query("order_by_category", graph_sql(f"""
SELECT label, r, list_position({[*NODE_LABELS, *EDGE_LABELS]}, label)::BIGINT AS place FROM counts ORDER BY place, label"""))
def order_by_category_query(w):
    return order_by_category(sizes(w), "label", (*NODE_LABELS, *EDGE_LABELS))


@query("order_by_metric", f"{RUNS_SQL} SELECT event_id, label, scheme, k, depth, t_total_ms FROM runs ORDER BY depth, k, event_id")
def order_by_metric_query(w):
    return order_by_metric(run_log(w), "depth", "k", "event_id")


@query("align_schemes", graph_sql("""
SELECT pattern, CASE WHEN n > 0 THEN n END AS padded, n AS plain
FROM (SELECT pattern, (SELECT count(*) FROM matches m WHERE m.pattern = p.pattern) AS n FROM patterns p)""",
    pattern_sql(), _MATCHES))
def align_schemes_query(w):
    """Plain counts of all patterns beside the padded counts of those that occur."""
    patterns = pattern_table(w.spark, PATTERNS)
    plain = match_pattern_batch(w.graph, patterns).withColumn("scheme", F.lit("plain"))
    padded = match_pattern_protected(patterns, w.nodes, w.sealed("nodes", "adjacency"), w.keys)[1]
    padded = padded.filter("matches > 0").select("pattern", "matches", F.lit("padded").alias("scheme"))
    return align_schemes(patterns, plain.unionByName(padded), "matches", ("padded", "plain"))


# --- snapshots ---------------------------------------------------------------------------

def next_nodes(w) -> DataFrame:
    """The nodes of the next snapshot, as a store returns them."""
    kept = w.nodes.filter(F.col("id") % 101 != 7).select(
        F.col("id").cast("string").alias("node_id"),
        F.when(F.col("id") % 53 == 3, F.lit("Inactive")).otherwise(F.col("label")).alias("label"),
    )
    users = w.table("events").select((F.lit(9000000000) + F.col("user_id")).cast("string").alias("node_id"))
    new = users.distinct().withColumn("label", F.lit(None).cast("string"))
    odd = w.nodes.filter(F.col("id") % 211 == 1).select(F.concat(F.lit("x"), F.col("id").cast("string")), "label")
    return kept.unionByName(new).union(odd)


def next_edges(w) -> DataFrame:
    total = F.col("u") + F.col("v")
    kept = w.edges.filter((F.col("u") % 101 != 7) & (F.col("v") % 101 != 7) & (total % 17 != 5)).select(
        F.col("u").cast("string").alias("src"),
        F.col("v").cast("string").alias("dst"),
        F.when(total % 19 == 2, F.lit("REPLY")).otherwise(F.col("label")).alias("edge_label"),
    )
    first = w.nodes.filter(F.col("id") % 101 != 7).agg(F.min("id")).scalar().cast("string")
    users = w.table("events").select((F.lit(9000000000) + F.col("user_id")).cast("string").alias("src"))
    new = users.distinct().select("src", first.alias("dst"), F.lit(None).cast("string").alias("edge_label"))
    return kept.unionByName(new)


_NEXT = """
users AS (SELECT DISTINCT 9000000000 + user_id AS id FROM events),
next_nodes AS (SELECT id, CASE WHEN id % 53 = 3 THEN 'Inactive' ELSE label END AS label FROM nodes WHERE id % 101 <> 7
  UNION ALL SELECT id, 'Inactive' FROM users),
next_edges AS (SELECT u, v, CASE WHEN (u + v) % 19 = 2 THEN 'REPLY' ELSE label END AS label FROM edges
    WHERE u % 101 <> 7 AND v % 101 <> 7 AND (u + v) % 17 <> 5
  UNION ALL SELECT (SELECT min(id) FROM nodes WHERE id % 101 <> 7), id, 'SEND' FROM users),
next_sym AS (SELECT u id, v nbr, label lbl FROM next_edges UNION ALL SELECT v, u, label FROM next_edges),
edge_changes AS (SELECT coalesce(a.u, b.u) u, coalesce(a.v, b.v) v, a.label old_label, b.label label
  FROM edges a FULL JOIN next_edges b ON a.u = b.u AND a.v = b.v WHERE a.label IS DISTINCT FROM b.label),
node_changes AS (SELECT coalesce(a.id, b.id) id, a.label old_label, b.label label
  FROM nodes a FULL JOIN next_nodes b ON a.id = b.id WHERE a.label IS DISTINCT FROM b.label),
changes AS (SELECT
  (SELECT count(*) FROM node_changes WHERE old_label IS NULL) AS nodes_added,
  (SELECT count(*) FROM node_changes WHERE label IS NULL) AS nodes_removed,
  (SELECT count(*) FROM node_changes WHERE old_label IS NOT NULL AND label IS NOT NULL) AS nodes_updated,
  (SELECT count(*) FROM edge_changes WHERE old_label IS NULL) AS edges_added,
  (SELECT count(*) FROM edge_changes WHERE label IS NULL) AS edges_removed,
  (SELECT count(*) FROM edge_changes WHERE old_label IS NOT NULL AND label IS NOT NULL) AS edges_relabelled)"""
NEXT = _NEXT.strip()


def snapshot(w) -> tuple[DataFrame, DataFrame]:
    """The next state as (id, label) and (u, v, label)."""
    nodes = clean_node_snapshot(next_nodes(w)).select("id", "label")
    return nodes, clean_edge_snapshot(next_edges(w))


def old_state(w) -> State:
    """The state before the snapshot, to be written in the caller's scratch scope; lists and entries are sealed where it is."""
    lists = protect_adjacency(build_adjacency(w.edges), w.keys)
    index = LabelIndex(*label_index_rows(label_histogram(w.nodes, w.edges), w.keys))
    return State(w.nodes.select("id", "label"), w.edges.select("u", "v", "label"), lists, index)


@query("sync_nodes_added", graph_sql("SELECT id, label FROM node_changes WHERE old_label IS NULL", NEXT))
def sync_nodes_added(w):
    return added(w.nodes, snapshot(w)[0], ["id"])


@query("sync_nodes_removed", graph_sql("SELECT id, old_label AS label FROM node_changes WHERE label IS NULL", NEXT))
def sync_nodes_removed(w):
    return removed(w.nodes.select("id", "label"), snapshot(w)[0], ["id"])


@query("sync_labels_changed", graph_sql(
    "SELECT id, old_label, label FROM node_changes WHERE old_label IS NOT NULL AND label IS NOT NULL", NEXT))
def sync_labels_changed(w):
    return relabelled(w.nodes, snapshot(w)[0], ["id"])


@query("sync_adjacency_changed", graph_sql("SELECT id, 0::BIGINT AS piece FROM nodes WHERE id % 7 = 0 AND id % 101 <> 7"))
def sync_adjacency_changed(w):
    """Against a snapshot in which some blobs were replaced, some are empty and some nodes are gone."""
    other = F.concat(F.col("adj_ct"), F.lit("new").cast("binary"))
    own = w.sealed("adjacency").adjacency
    given = own.filter(F.col("node_id") % 101 != 7).select(
        "node_id", "piece",
        F.when(F.col("node_id") % 7 == 0, other)
        .when(F.col("node_id") % 7 == 1, F.lit("").cast("binary"))
        .otherwise(F.col("adj_ct")).alias("adj_ct"),
    )
    changed = adjacency_changed(own, given, ["node_id", "piece"])
    return changed.groupBy(F.col("node_id").alias("id")).agg(F.min("piece").alias("piece"))


def _rebuilt(w, came: bool):
    """Neighbour lists of the endpoints of added (removed) edges after the change."""
    old = w.edges.select("u", "v", "label")
    nodes, new = snapshot(w)
    new = save(new, "snapshot-edges")
    changed = added(old, new, ["u", "v"]) if came else removed(old, new, ["u", "v"])
    ends = save(changed.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ends")
    gone = removed(w.nodes, nodes, ["id"])
    lists = save(rebuild_adjacency(w.sealed("adjacency").adjacency, new, ends, gone, w.keys), "rebuilt")
    touched = filter_by_keys(lists, "node_id", ends.withColumnRenamed("id", "node_id"))
    opened = open_lists(touched, w.keys)
    return opened.groupBy(F.col("node_id").alias("id")).agg(F.sum(F.size("nbrs")).alias("neighbours"))


_REBUILT = """
SELECT id, count(*) AS neighbours FROM next_sym WHERE id IN (
  SELECT u FROM edge_changes WHERE {which} UNION SELECT v FROM edge_changes WHERE {which}) GROUP BY id"""


@query("sync_edges_added", graph_sql(_REBUILT.format(which="old_label IS NULL"), NEXT))
def sync_edges_added(w):
    return _rebuilt(w, came=True)


@query("sync_edges_removed", graph_sql(_REBUILT.format(which="label IS NULL") .replace(
    "WHERE id IN", "WHERE id IN (SELECT id FROM next_nodes) AND id IN"), NEXT))
def sync_edges_removed(w):
    return _rebuilt(w, came=False)


@query("sync_edges_changed", graph_sql("SELECT u, v, old_label, label FROM edge_changes", NEXT))
def sync_edges_changed(w):
    """Edges that came, went or were relabelled."""
    return changes(w.edges, snapshot(w)[1], ["u", "v"]).drop("change")


_SUMMARY = ("SELECT *, nodes_added + nodes_removed + nodes_updated + edges_added + edges_removed + edges_relabelled > 0 "
            "AS changed FROM changes")


@query("sync_summary", graph_sql(_SUMMARY, NEXT))
def sync_summary_query(w):
    return sync_summary(w.nodes, w.edges, *snapshot(w))


@query("graph_stats_after_sync", graph_sql("""
SELECT 'nodes' AS stat, count(*)::DOUBLE AS value FROM next_nodes UNION ALL SELECT 'edges', count(*)::DOUBLE FROM next_edges
UNION ALL SELECT 'max_degree', max(d)::DOUBLE FROM next_degrees
UNION ALL SELECT 'avg_degree', round(sum(d) / count(*)::DOUBLE, 2) FROM next_degrees
UNION ALL SELECT 'labels', count(*)::DOUBLE FROM next_counts
UNION ALL SELECT 'label:' || label, r::DOUBLE FROM next_counts""", NEXT + """, next_degrees AS (
  SELECT n.id, count(e.id) AS d FROM next_nodes n
  LEFT JOIN (SELECT u AS id FROM next_edges UNION ALL SELECT v FROM next_edges) e ON n.id = e.id GROUP BY n.id),
next_counts AS (SELECT label, count(*) AS r FROM
  (SELECT label FROM next_nodes UNION ALL SELECT label FROM next_edges) GROUP BY label)"""))
def graph_stats_after_sync(w):
    """Sizes, degrees and elements per label after a snapshot, from the counters before it and the changes alone."""
    before = counters_of(w.nodes, w.edges)
    nodes, edges = snapshot(w)
    node_changes = save(changes(w.nodes, nodes, ["id"]), "node-changes")
    found = save(edge_changes(w.edges, edges, node_changes, nodes), "edge-changes")
    return graph_stats_of(update_counters(before, node_changes, found))


@query("sync_apply", graph_sql(f"""
SELECT 'node' AS part, label, count(*) AS n FROM next_nodes GROUP BY label
UNION ALL SELECT 'edge', label, count(*) FROM next_edges GROUP BY label
UNION ALL SELECT 'neighbour', lbl, count(*) FROM next_sym GROUP BY lbl
UNION ALL SELECT 'index:' || kind, '', count(*) FROM (SELECT 'v' kind FROM next_nodes UNION ALL SELECT 'e' FROM next_edges) GROUP BY kind
UNION ALL SELECT 'index rows', '', sum({pad('r')})::BIGINT FROM (SELECT label, count(*) r FROM
  (SELECT label FROM next_nodes UNION ALL SELECT label FROM next_edges) GROUP BY label)""", NEXT))
def sync_apply_query(w):
    new = snapshot(w)  # the graph is built outside of the scope
    with scratch(w.spark):
        old = write_state(old_state(w), f"{new_path(w.spark, 'state')}/before")
    state, _ = sync_apply(old, *new, w.keys)
    lists = open_lists(state.adjacency, w.keys).select(F.explode("nbrs.lbl").alias("label"))
    kinds = open_entries(state.index.entries, w.keys)
    one = F.count(F.lit(1)).alias("n")
    parts = [
        state.nodes.groupBy("label").agg(one).select(F.lit("node").alias("part"), "label", "n"),
        state.edges.groupBy("label").agg(one).select(F.lit("edge").alias("part"), "label", "n"),
        lists.groupBy("label").agg(one).select(F.lit("neighbour").alias("part"), "label", "n"),
        kinds.groupBy("kind").agg(one).select(F.concat(F.lit("index:"), "kind").alias("part"), F.lit("").alias("label"), "n"),
        state.index.entries.agg(one).select(F.lit("index rows").alias("part"), F.lit("").alias("label"), "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("sync_touched_nodes", graph_sql("SELECT u AS id FROM edge_changes UNION SELECT v FROM edge_changes", NEXT))
def sync_touched_nodes(w):
    return touched_nodes(changes(w.edges, snapshot(w)[1], ["u", "v"]))


_COLUMNS = ", ".join(COUNTERS)


@query("sync_stream", graph_sql(f"""
SELECT 's1' AS snapshot_id, {', '.join(f'0::BIGINT AS {c}' for c in COUNTERS)}, FALSE AS changed, FALSE AS failed
UNION ALL SELECT 's2', {_COLUMNS}, TRUE, FALSE FROM changes
UNION ALL SELECT 's3', {', '.join('0' for _ in COUNTERS)}, FALSE, FALSE
UNION ALL SELECT 's4', {', '.join('0' for _ in COUNTERS)}, FALSE, TRUE""", NEXT))
def sync_stream_query(w):
    """The same graph, the next snapshot, the next snapshot again, and one that cannot be read."""
    root = new_path(w.spark, "sync")
    write_labelled_snapshot(f"{root}/drops/a", w.nodes, w.edges)
    next_nodes(w).write.parquet(f"{root}/drops/b/nodes")
    next_edges(w).write.parquet(f"{root}/drops/b/edges")
    with scratch(w.spark):
        initialise(old_state(w), f"{root}/state")
    for name, drop in (("s1", "a"), ("s2", "b"), ("s3", "b"), ("s4", "missing")):
        manifest = w.spark.createDataFrame([(name, f"{root}/drops/{drop}")], "snapshot_id string, path string")
        manifest.coalesce(1).write.mode("append").json(f"{root}/manifests")
    start_sync(w.spark, f"{root}/manifests", f"{root}/state", w.keys, interval=None).awaitTermination()
    history = sync_history(w.spark, f"{root}/state").filter("batch_id >= 0")
    return history.select("snapshot_id", *COUNTERS, "changed", F.col("error").isNotNull().alias("failed"))


# --- questions ---------------------------------------------------------------------------

PATTERN_TEXTS = ("Find Executive BROADCAST External", "find external internal external", "Find Influencer FOLLOWS Person",
                 "Find Executive REPLY Manager")
LABEL_TEXTS = ("How many Executive nodes?", "How many Employee nodes?", "count Manager people", "number of external parties",
               "how many inactive ones are there")
PLAIN_TEXTS = ("How many nodes?", "How many edges?", "number of nodes labelled Executive", "how many SEND does node 42 have",
               "total edges please")


def question_log(w) -> DataFrame:
    """(qid, question): a question about every customer, supplier, part and order, a few per nation, and free text."""

    def ask(name, base, column, prefix, suffix="", offset=0):
        node = entity(base, column)
        text = F.concat(F.lit(prefix), node.cast("string"), F.lit(suffix))
        return w.table(name).select((node + offset).alias("qid"), text.alias("question"))

    nation = w.table("nation")
    n = F.col("n_nationkey").cast("bigint")
    here = entity(NATION, "n_nationkey").cast("string")

    def per_nation(offset, text):
        return nation.select((entity(NATION, "n_nationkey") + offset).alias("qid"), text.alias("question"))

    def pick(texts):
        return F.element_at(F.array(*[F.lit(t) for t in texts]), (n % len(texts) + 1).cast("int"))

    users = w.table("conversations").filter("role = 'user'").select(
        (F.lit(7000000000) + F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question")
    )
    parts = [
        ask("customer", CUSTOMER, "c_custkey", "How many connections does node ", " have?"),
        ask("supplier", SUPPLIER, "s_suppkey", "What label is node ", "?"),
        ask("part", PART, "p_partkey", "node ", " degree"),
        ask("orders", ORDER, "o_orderkey", "Tell me: what TYPE is node "),
        ask("nation", NATION, "n_nationkey", "BFS from node ", " depth 2"),
        ask("nation", NATION, "n_nationkey", "reachable from ", " depth 9", 100),
        ask("nation", NATION, "n_nationkey", "bfs from ", "", 200),
        ask("nation", NATION, "n_nationkey", "How many friends does node ", " have?", 300),
        per_nation(400, F.concat(F.lit("Can node "), here, F.lit(" reach node "), entity(SUPPLIER, "n_nationkey").cast("string"))),
        per_nation(500, F.concat(F.lit("path from "), here, F.lit(" to "), entity(REGION, "n_regionkey").cast("string"))),
        per_nation(600, pick(PATTERN_TEXTS)),
        per_nation(700, pick(LABEL_TEXTS)),
        per_nation(800, pick(PLAIN_TEXTS)),
        users,
    ]
    return reduce(DataFrame.unionByName, parts)


def _pick_sql(texts):
    return f"([{', '.join(repr(t) for t in texts)}])[n_nationkey % {len(texts)} + 1]"


_N = "4000000000 + n_nationkey::BIGINT"
_QUESTIONS = f"""
questions AS MATERIALIZED (
  SELECT 1000000000 + c_custkey AS qid, 'How many connections does node ' || (1000000000 + c_custkey) || ' have?' AS question FROM customer
  UNION ALL SELECT 2000000000 + s_suppkey, 'What label is node ' || (2000000000 + s_suppkey) || '?' FROM supplier
  UNION ALL SELECT 3000000000 + p_partkey, 'node ' || (3000000000 + p_partkey) || ' degree' FROM part
  UNION ALL SELECT 5000000000 + o_orderkey, 'Tell me: what TYPE is node ' || (5000000000 + o_orderkey) FROM orders
  UNION ALL SELECT {_N}, 'BFS from node ' || ({_N}) || ' depth 2' FROM nation
  UNION ALL SELECT {_N} + 100, 'reachable from ' || ({_N}) || ' depth 9' FROM nation
  UNION ALL SELECT {_N} + 200, 'bfs from ' || ({_N}) FROM nation
  UNION ALL SELECT {_N} + 300, 'How many friends does node ' || ({_N}) || ' have?' FROM nation
  UNION ALL SELECT {_N} + 400, 'Can node ' || ({_N}) || ' reach node ' || (2000000000 + n_nationkey::BIGINT) FROM nation
  UNION ALL SELECT {_N} + 500, 'path from ' || ({_N}) || ' to ' || (6000000000 + n_regionkey::BIGINT) FROM nation
  UNION ALL SELECT {_N} + 600, {_pick_sql(PATTERN_TEXTS)} FROM nation
  UNION ALL SELECT {_N} + 700, {_pick_sql(LABEL_TEXTS)} FROM nation
  UNION ALL SELECT {_N} + 800, {_pick_sql(PLAIN_TEXTS)} FROM nation
  UNION ALL SELECT 7000000000 + conv_id * 1000 + turn, text FROM conversations WHERE role = 'user')"""

(_D1, _D2), _L, (_B1, _B2), (_P1, _P2), _F = DEGREE, LABEL, BFS, PAIR, PATTERN
_NAMED = " ".join(f"WHEN contains(q, '{n.lower()}') THEN '{n}'" for n in NODE_LABELS)
_COUNTING = "(contains(q, 'how many') OR contains(q, 'count') OR contains(q, 'number'))"


def _x(pattern, group):
    return f"nullif(regexp_extract(q, '{pattern}', {group}), '')"


def _either(a, b, group):
    return f"CASE WHEN regexp_matches(q, '{a}') THEN {_x(a, group)} ELSE {_x(b, group)} END"


def _capital(text):
    return f"upper(substr({text}, 1, 1)) || substr({text}, 2)"


_ROUTED = f"""
routed AS MATERIALIZED (SELECT qid, question, q, CASE
  WHEN contains(q, 'how many nodes') OR contains(q, 'count nodes') OR contains(q, 'total nodes') OR contains(q, 'number of nodes') THEN 'node_count'
  WHEN contains(q, 'how many edges') OR contains(q, 'count edges') OR contains(q, 'total edges') OR contains(q, 'number of edges') THEN 'edge_count'
  WHEN regexp_matches(q, '{_D1}') OR regexp_matches(q, '{_D2}') THEN 'degree'
  WHEN regexp_matches(q, '{_L}') THEN 'label'
  WHEN (CASE {_NAMED} END) IS NOT NULL AND {_COUNTING} THEN 'label_count'
  WHEN regexp_matches(q, '{_B1}') OR regexp_matches(q, '{_B2}') THEN 'bfs'
  WHEN regexp_matches(q, '{_P1}') OR regexp_matches(q, '{_P2}') THEN 'pair'
  WHEN regexp_matches(q, '{_F}') THEN 'pattern' ELSE 'fallback' END AS intent
  FROM (SELECT qid, question, lower(question) AS q FROM questions)),
parsed AS MATERIALIZED (SELECT qid, intent,
  TRY_CAST(CASE intent
    WHEN 'degree' THEN CASE WHEN regexp_matches(q, '{_D1}') THEN coalesce({_x(_D1, 1)}, {_x(_D1, 2)}) ELSE {_x(_D2, 1)} END
    WHEN 'label' THEN coalesce({_x(_L, 1)}, {_x(_L, 2)})
    WHEN 'bfs' THEN {_either(_B1, _B2, 1)} WHEN 'pair' THEN {_either(_P1, _P2, 1)} END AS BIGINT) AS node,
  TRY_CAST(CASE WHEN intent = 'pair' THEN {_either(_P1, _P2, 2)} END AS BIGINT) AS other,
  CASE WHEN intent = 'bfs' THEN least(coalesce(CAST({_either(_B1, _B2, 2)} AS BIGINT), 2), 3)::INT END AS depth,
  CASE WHEN intent = 'label_count' THEN CASE {_NAMED} END END AS label,
  CASE WHEN intent = 'pattern' THEN {_capital(_x(_F, 1))} END AS src_label,
  CASE WHEN intent = 'pattern' THEN upper({_x(_F, 2)}) END AS edge_label,
  CASE WHEN intent = 'pattern' THEN {_capital(_x(_F, 3))} END AS dst_label
  FROM routed)"""


@query("route_questions", "WITH " + _QUESTIONS.strip() + "," + _ROUTED + " SELECT qid, intent FROM routed")
def route_questions_query(w):
    return route_questions(question_log(w)).select("qid", "intent")


@query("question_parameters", "WITH " + _QUESTIONS.strip() + "," + _ROUTED + " SELECT * FROM parsed")
def question_parameters_query(w):
    return question_parameters(route_questions(question_log(w))).drop("question")


_ASKING = "SELECT DISTINCT node AS seed FROM parsed WHERE intent IN ('bfs', 'pair') AND node IS NOT NULL"


@query("answer_questions", graph_sql("""
SELECT qid, intent, CASE intent
  WHEN 'node_count' THEN (SELECT count(*) FROM nodes)::VARCHAR
  WHEN 'edge_count' THEN (SELECT count(*) FROM edges)::VARCHAR
  WHEN 'degree' THEN coalesce((SELECT degree FROM nodes WHERE id = node), 0)::VARCHAR
  WHEN 'label' THEN coalesce((SELECT n.label FROM nodes n WHERE id = node), 'not found')
  WHEN 'label_count' THEN (SELECT count(*) FROM nodes n WHERE n.label = p.label)::VARCHAR
  WHEN 'bfs' THEN coalesce((SELECT sum(n) - 1 FROM per_level l WHERE l.seed = node AND l.depth <= p.depth), 0)::BIGINT::VARCHAR
  WHEN 'pair' THEN CASE WHEN node = other AND EXISTS (SELECT 1 FROM nodes WHERE id = node) THEN 'YES'
    WHEN EXISTS (SELECT 1 FROM reached r WHERE r.seed = p.node AND r.node = p.other AND r.depth > 0) THEN 'YES'
    ELSE 'NO (within 4 hops)' END
  WHEN 'pattern' THEN (SELECT count(*) FROM sym s WHERE s.label = p.src_label AND s.lbl = p.edge_label AND s.nbr_label = p.dst_label)::VARCHAR
  ELSE '?' END AS result FROM parsed p""", _QUESTIONS.strip(), _ROUTED.strip(), *level_ctes(_ASKING, 4)))
def answer_questions_query(w):
    return answer_questions(question_log(w), w.graph, w.neighbour_table)
