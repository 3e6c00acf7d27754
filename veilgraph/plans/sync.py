"""Reconcile a stored graph with a snapshot: what changed, and the new tables.

A stored state is cut into parts: nodes, edges and lists by a hash of their key,
the index by token.  Each part lies in a directory of its own for each version,
and a manifest says which version of which part belongs to a state, with the
number of rows and a digest of the parts of nodes and edges.  A snapshot is
digested in the same way, by one aggregate; only parts that differ are compared,
and a new state writes the touched parts and its manifest and nothing else.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions.arithmetic import piece_count, spread
from veilgraph.functions.crypto import Keys, keyed_token
from veilgraph.operators.adjacency import LIST_ROWS
from veilgraph.operators.index import LabelIndex, label_histogram, label_index_rows
from veilgraph.operators.protect import protect_adjacency
from veilgraph.operators.skew import Dimension, attach, filter_by_keys, join_small
from veilgraph.runtime import OPEN_FILES, codec, keep, new_path, save, scratch, setting
from veilgraph.sources.store import with_endpoints

EDGE_KEY = ["u", "v"]
# Parts of a state: at least so many, and more for tables of more rows a part.
PARTS = 64
PART_ROWS = 2_000_000


@dataclass(frozen=True)
class Table:
    """Columns of a stored table, what its parts are cut by (a token is a part by itself), and whether it is digested."""

    schema: str
    key: tuple[str, ...]
    by: str = "part"
    digested: bool = False


TABLES = {
    "nodes": Table("id bigint, label string", ("id",), digested=True),
    "edges": Table("u bigint, v bigint, label string", ("u", "v"), digested=True),
    "adjacency": Table("node_id bigint, piece bigint, adj_ct binary", ("node_id",)),
    "index": Table("slot bigint, ct binary", ("token",), "token"),
    "sizes": Table("p_r bigint", ("token",), "token"),
}


@dataclass(frozen=True)
class Part:
    """One part of a table, in the version that a state has of it."""

    table: str
    part: str
    version: str
    rows: int
    digest: str


@dataclass(frozen=True)
class State:
    """nodes (id, label), edges (u, v, label) and what is derived from them; edges end at nodes of the state."""

    nodes: DataFrame
    edges: DataFrame
    adjacency: DataFrame  # (node_id, piece, adj_ct)
    index: LabelIndex
    path: str | None = None
    n_parts: int = PARTS
    parts: tuple[Part, ...] = ()


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, old_label, label, change) of every element that came, went or changed its label."""
    before = old.select(*key, F.col("label").alias("old_label"), F.lit(True).alias("_old"))
    after = new.select(*key, "label", F.lit(True).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(~F.col("label").eqNullSafe(F.col("old_label")), "relabelled")
    )
    both = before.join(after, key, "full_outer").withColumn("change", change)
    return both.filter(F.col("change").isNotNull()).drop("_old", "_new")


def added(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return new.join(old.select(*key), key, "left_anti")


def removed(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key), key, "left_anti")


def relabelled(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, old_label, label) of elements in both whose label differs."""
    before = old.select(*key, F.col("label").alias("old_label"))
    both = new.select(*key, "label").join(before, key)
    return both.filter(~F.col("label").eqNullSafe(F.col("old_label"))).select(*key, "old_label", "label")


def adjacency_changed(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, adj_ct) of blobs that are not empty in the snapshot and not the stored ones.

    Compares stored bytes; encrypting again would give other bytes every time.
    """
    before = old.select(*key, F.col("adj_ct").alias("_old"))
    both = new.select(*key, "adj_ct").join(before, key)
    differs = (F.length("adj_ct") > 0) & ~F.col("adj_ct").eqNullSafe(F.col("_old"))
    return both.filter(differs).select(*key, "adj_ct")


def _tally(found: DataFrame, prefix: str) -> DataFrame:
    kinds = (("added", "added"), ("removed", "removed"), ("relabelled", "updated" if prefix == "nodes" else "relabelled"))
    return found.agg(
        *[F.count(F.when(F.col("change") == kind, 1)).alias(f"{prefix}_{name}") for kind, name in kinds]
    )


def summary_of(node_changes: DataFrame, edge_changes: DataFrame) -> DataFrame:
    """One row of counters over the changes of both tables."""
    nodes, edges = _tally(node_changes, "nodes"), _tally(edge_changes, "edges")
    edge_counts = edges.select(F.struct(*edges.columns).alias("row")).scalar()
    row = nodes.select("*", *[edge_counts.getField(c).alias(c) for c in edges.columns])
    return row.withColumn("changed", sum((F.col(c) for c in row.columns), F.lit(0)) > 0)


def sync_summary(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """One row of counters; one full outer join per table.

    As in ``sync_apply``, an edge with an endpoint outside the snapshot's nodes is not there, and the old edges end
    at old nodes.
    """
    with scratch(old_nodes.sparkSession):
        node_changes = save(changes(old_nodes, new_nodes, ["id"]), "node-changes")
        found = edge_changes(old_edges, new_edges, node_changes, new_nodes)
        return keep(save(summary_of(node_changes, found), "sync-summary"))


def edge_changes(old: DataFrame, new: DataFrame, node_changes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """``changes`` of edges where an edge of ``new`` counts only if both its ends are in ``new_nodes``.

    Old edges end at old nodes, so those in both lose an end only with a removed node; for edges that came, which
    are few, the ends are looked up.
    """
    gone = save(node_changes.filter("change = 'removed'").select("id"), "gone-nodes")
    before = old.select(*EDGE_KEY, F.col("label").alias("old_label"), F.lit(True).alias("_old"))
    after = new.select(*EDGE_KEY, "label", F.lit(True).alias("_new"))
    both = before.join(after, EDGE_KEY, "full_outer")
    if not gone.isEmpty():
        for end in EDGE_KEY:
            lost = gone.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
            both = join_small(both, save(lost, "lost-ends"), [end], "left")
        dead = F.col("_u").isNotNull() | F.col("_v").isNotNull()
        both = both.withColumns(
            {"label": F.when(~dead, F.col("label")), "_new": F.when(~dead, F.col("_new"))}
        ).drop("_u", "_v")
    kept = ~F.col("label").eqNullSafe(F.col("old_label")) | F.col("_old").isNull() | F.col("_new").isNull()
    found = save(both.filter(kept & (F.col("_old").isNotNull() | F.col("_new").isNotNull())), "changed-edges")
    came = with_endpoints(found.filter("_old IS NULL"), new_nodes, "u", "v")
    whole = found.filter("_old IS NOT NULL").unionByName(came.select(*found.columns))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("relabelled")
    return whole.withColumn("change", change).drop("_old", "_new")


def touched_nodes(edge_changes: DataFrame) -> DataFrame:
    """(id): endpoints of edges that came, went or changed their label."""
    return edge_changes.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def touched_labels(node_changes: DataFrame, edge_changes: DataFrame) -> DataFrame:
    """(label): labels that gained or lost an entry, the old and the new label of each change."""
    both = node_changes.select("old_label", "label").unionByName(edge_changes.select("old_label", "label"))
    return both.select(F.explode(F.array("old_label", "label")).alias("label")).filter("label IS NOT NULL").distinct()


def rebuild_adjacency(
    adjacency: DataFrame, edges: DataFrame, touched: DataFrame, gone: DataFrame, keys: Keys, list_rows: int = LIST_ROWS
) -> DataFrame:
    """Neighbour lists after a change: new blobs for ``touched`` nodes (id), none for those ``gone`` (id), the rest as is.

    The lists come from the reconciled edges, never from an older list.
    """
    ends = save(touched.select("id").distinct(), "touched")
    stale = save(ends.unionByName(gone.select("id")).distinct().withColumnRenamed("id", "node_id"), "stale")
    lists = build_adjacency_of(edges, ends, list_rows)
    kept = filter_by_keys(adjacency, "node_id", stale, keep=False)
    return kept.unionByName(protect_adjacency(lists, keys).select(*adjacency.columns))


def build_adjacency_of(edges: DataFrame, ids: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """``build_adjacency`` for the owners in the written table ``ids`` (id) only.

    Edges are cut down to those owners first; an owner's degree is the number of its rows then.
    """
    near = filter_by_keys(edges, "u", ids.withColumnRenamed("id", "u"))
    far = filter_by_keys(edges, "v", ids.withColumnRenamed("id", "v"))

    def side(rows, own, other):
        return rows.select(F.col(own).alias("id"), F.col(other).alias("nbr"), "label")

    rows = save(side(near, "u", "v").unionByName(side(far, "v", "u")), "touched-neighbours")
    counts = save(rows.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "touched-degrees")
    sized = attach(rows, "id", Dimension.of(counts, "id", "degree"), {"degree": "_degree"}, F.xxhash64("nbr"))
    piece = F.pmod(spread(F.col("nbr")), piece_count(F.col("_degree"), list_rows))
    entries = sized.select("id", piece.alias("piece"), F.struct("nbr", F.col("label").alias("lbl")).alias("entry"))
    return entries.groupBy("id", "piece").agg(F.array_sort(F.collect_list("entry")).alias("nbrs"))


def part_of(key: Iterable[str], n_parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_parts)).cast("string").alias("part")


def _digests(rows: DataFrame, by: Column, digested: bool = True) -> DataFrame:
    """(part, rows, digest): equal tables have equal digests, whatever the order of their rows."""
    number = F.xxhash64(*rows.columns).cast("decimal(20,0)")
    digest = F.sum(number).cast("string") if digested else F.lit("")
    return rows.groupBy(by.alias("part")).agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest"))


def _tables(state: State) -> dict[str, DataFrame]:
    return dict(zip(TABLES, (state.nodes, state.edges, state.adjacency, state.index.entries, state.index.sizes)))


def _write_parts(rows: DataFrame, name: str, path: str, n_parts: int) -> list[Part]:
    """Write the parts that ``rows`` have as the version of ``path``; the same again replaces just those."""
    root, version = os.path.split(path)
    table = TABLES[name]
    placed = rows.withColumn("version", F.lit(version))
    if table.by == "part":
        placed = placed.withColumn("part", part_of(table.key, n_parts)).repartition("part")
    spark = rows.sparkSession
    writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", codec(spark))
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
        writer.partitionBy(table.by, "version").parquet(f"{root}/{name}")
    schema = f"{table.schema}, {table.by} string, version string"
    try:
        written = spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/{table.by}=*/version={version}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    columns = [c.split()[0] for c in table.schema.split(", ")]
    found = _digests(written.select(*columns, table.by), F.col(table.by), False) if not table.digested else (
        _digests(written.select(*columns), part_of(table.key, n_parts))
    )
    # One row per part, or per label.
    return [Part(name, r["part"], version, r["rows"], r["digest"]) for r in found.collect()]


MANIFEST = "n_parts int, table string, part string, version string, rows bigint, digest string"


def _write_manifest(spark: SparkSession, path: str, n_parts: int, parts: list[Part]) -> None:
    rows = [(n_parts, p.table, p.part, p.version, p.rows, p.digest) for p in sorted(parts, key=lambda p: (p.table, p.part))]
    rows = rows or [(n_parts, None, None, None, 0, None)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def write_state(state: State, path: str) -> State:
    """Write all parts of a state as the version that ``path`` ends with, and its manifest, and open it.

    States of one graph lie beside each other: they share the parts in which they do not differ.
    """
    spark = state.nodes.sparkSession
    n_parts = max(PARTS, -(-state.edges.count() // PART_ROWS))
    parts = [p for name, rows in _tables(state).items() for p in _write_parts(rows, name, path, n_parts)]
    _write_manifest(spark, path, n_parts, parts)
    return read_state(spark, path)


def read_state(spark: SparkSession, path: str) -> State:
    """The state of a manifest; an asked token or part opens its own directories."""
    rows = spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()  # a row per part, or per label
    parts = tuple(Part(*[r[c] for c in ("table", "part", "version", "rows", "digest")]) for r in rows if r["table"])
    nodes, edges, adjacency, entries, sizes = (_open(spark, path, name, parts) for name in TABLES)
    index = LabelIndex(entries.select("token", "slot", "ct"), sizes.select("token", "p_r"))
    return State(nodes, edges, adjacency, index, path, rows[0]["n_parts"], parts)


def _open(spark: SparkSession, path: str, name: str, parts: Iterable[Part]) -> DataFrame:
    root, table = os.path.dirname(path), TABLES[name]
    columns = [c.split()[0] for c in table.schema.split(", ")] + ([] if table.by == "part" else [table.by])
    schema = f"{table.schema}, {table.by} string, version string"
    paths = [f"{root}/{name}/{table.by}={p.part}/version={p.version}" for p in parts if p.table == name]
    if not paths:
        return spark.createDataFrame([], schema).select(*columns)
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*paths).select(*columns)


def _differing(state: State, name: str, rows: DataFrame) -> list[str]:
    """Parts in which ``rows`` are not the state's: one aggregate of the rows, and none of a state that was read."""

    def of(table: DataFrame) -> dict[str, tuple]:
        found = _digests(table.select(*columns), part_of(TABLES[name].key, state.n_parts)).collect()  # a row per part
        return {r["part"]: (r["rows"], r["digest"]) for r in found}

    columns = [c.split()[0] for c in TABLES[name].schema.split(", ")]
    if state.path:
        before = {p.part: (p.rows, p.digest) for p in state.parts if p.table == name}
    else:
        before = of(_tables(state)[name])
    after = of(rows)
    return sorted(p for p in before.keys() | after.keys() if before.get(p) != after.get(p))


def _some(state: State, name: str, parts: list[str]) -> DataFrame:
    """The rows of a state in some parts; of a state that was read no other part is opened."""
    if state.path:
        asked = set(parts)
        spark = state.nodes.sparkSession
        return _open(spark, state.path, name, [p for p in state.parts if p.table == name and p.part in asked])
    return _in_parts(_tables(state)[name], TABLES[name].key, parts, state.n_parts)


def _in_parts(rows: DataFrame, key: Iterable[str], parts: list[str], n_parts: int) -> DataFrame:
    return rows.filter(part_of(key, n_parts).isin(parts)) if len(parts) < n_parts else rows


def _parts_of(rows: DataFrame, key: Iterable[str], n_parts: int) -> list[str]:
    return [r[0] for r in rows.select(part_of(key, n_parts)).distinct().collect()]


def sync_apply(
    old: State, snap_nodes: DataFrame, snap_edges: DataFrame, keys: Keys, path: str | None = None
) -> tuple[State, DataFrame]:
    """The state after a snapshot, and the summary row.  Nothing is written when nothing changed.

    Edges with an endpoint outside the snapshot's nodes are gone with it.  Lists and index entries are encrypted
    again only for touched nodes and labels.  The new state has its manifest at ``path``, beside that of ``old``,
    and shares the parts with it in which nothing changed.  A state that was never written is written first.
    """
    spark, given = snap_nodes.sparkSession, old
    if path is None:
        root = os.path.dirname(old.path) if old.path else new_path(spark, "state")
        path = os.path.join(root, uuid.uuid4().hex[:12])
    with scratch(spark):
        nodes = save(snap_nodes.select("id", "label"), "sync-nodes")
        listed = save(snap_edges.select("u", "v", "label"), "sync-edges")
        differing = _differing(old, "nodes", nodes)
        node_changes = save(
            changes(_some(old, "nodes", differing), _in_parts(nodes, ["id"], differing, old.n_parts), ["id"]), "node-changes"
        )
        gone = save(node_changes.filter("change = 'removed'").select("id"), "gone")
        differing = _differing(old, "edges", listed)
        if not gone.isEmpty():
            # The snapshot may still list edges of a node that it lacks.
            lost = [filter_by_keys(old.edges, end, gone.withColumnRenamed("id", end)) for end in EDGE_KEY]
            differing = sorted({*differing, *_parts_of(lost[0].unionByName(lost[1]), EDGE_KEY, old.n_parts)})
        alive = with_endpoints(_in_parts(listed, EDGE_KEY, differing, old.n_parts), nodes, "u", "v")
        alive = save(alive, "alive-edges")
        found = save(changes(_some(old, "edges", differing), alive, EDGE_KEY), "edge-changes")
        summary = keep(save(summary_of(node_changes, found), "sync-summary"))
        if not summary.first()["changed"]:
            return given, summary
        if old.path is None or os.path.dirname(old.path) != os.path.dirname(path):
            old = write_state(old, os.path.join(os.path.dirname(path), f"before-{os.path.basename(path)}"))
        return _apply(old, nodes, alive, node_changes, found, gone, keys, path), summary


def _apply(
    old: State, nodes: DataFrame, alive: DataFrame, node_changes: DataFrame, found: DataFrame, gone: DataFrame, keys: Keys, path: str
) -> State:
    """Write the touched parts of each table, then the manifest."""
    spark, n = nodes.sparkSession, old.n_parts
    replaced: list[tuple[str, list[str]]] = []
    written: list[Part] = []

    def write(name: str, parts: list[str], rows: DataFrame) -> None:
        replaced.append((name, parts))
        written.extend(_write_parts(rows, name, path, n) if parts else [])

    touched = _parts_of(node_changes, ["id"], n)
    write("nodes", touched, _in_parts(nodes, ["id"], touched, n))
    touched = _parts_of(found, EDGE_KEY, n)
    write("edges", touched, _in_parts(alive, EDGE_KEY, touched, n))
    now = _merged(old.parts, replaced, written)
    new_nodes, new_edges = _open(spark, path, "nodes", now), _open(spark, path, "edges", now)

    ends = save(touched_nodes(found), "touched")
    stale = save(ends.unionByName(gone).distinct().withColumnRenamed("id", "node_id"), "stale")
    touched = _parts_of(stale, ["node_id"], n)
    lists = protect_adjacency(build_adjacency_of(new_edges, ends), keys)
    kept = filter_by_keys(_some(old, "adjacency", touched), "node_id", stale, keep=False)
    write("adjacency", touched, kept.unionByName(lists.select(*kept.columns)))

    labels = save(touched_labels(node_changes, found), "touched-labels")
    entries, sizes = label_index_rows(filter_by_keys(label_histogram(new_nodes, new_edges), "label", labels), keys)
    tokens = [r[0] for r in labels.select(keyed_token(F.col("label"), keys.token)).collect()]
    write("index", tokens, entries)  # sealed where its parts are written, once
    write("sizes", tokens, sizes)
    _write_manifest(spark, path, n, _merged(old.parts, replaced, written))
    return read_state(spark, path)


def _merged(parts: Iterable[Part], replaced: list[tuple[str, list[str]]], written: list[Part]) -> list[Part]:
    """``parts`` without those that were replaced, and what was written for them; a part without rows is gone."""
    away = {(name, part) for name, some in replaced for part in some}
    return [p for p in parts if (p.table, p.part) not in away] + written
