"""Snapshot reconciliation as a Structured Streaming job over snapshot manifests.

A manifest is one small JSON file {"snapshot_id", "path", "sequence"}; the snapshot's
tables lie under ``path``/nodes and ``path``/edges, and ``sequence`` orders the
manifests of one file.  (Streaming the snapshot rows
themselves could split a snapshot over two batches.)  Every batch writes the
touched parts of its state under its own batch id and reads the newest state of
an earlier batch, so a replayed batch writes the same again.  A pointer names
that state and the history is merged from time to time, so a batch reads a
bounded number of files however many came before it.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilgraph.functions.crypto import Keys
from veilgraph.plans.sync import State, adjacency_changed, read_state, sync_apply, write_state
from veilgraph.runtime import remove_path
from veilgraph.sources.snapshot import scan_edge_snapshot, scan_list_snapshot, scan_node_snapshot

MANIFEST = "snapshot_id string, path string, sequence bigint"
COUNTERS = ("nodes_added", "nodes_removed", "nodes_updated", "edges_added", "edges_removed", "edges_relabelled")
HISTORY = (
    "step int, snapshot_id string, state_path string, "
    + ", ".join(f"{c} bigint" for c in COUNTERS)
    + ", changed boolean, error string, lists_changed bigint"
)
INITIAL_BATCH = -1
MERGE_EVERY = 50
MOST_MANIFESTS = 1000
POINTER = "batch_id bigint, state_path string, before string"


def sync_history(spark: SparkSession, root: str) -> DataFrame:
    """One row per processed snapshot, with its batch and counters.

    Rows of a batch lie in a file of their own until they are merged into one file with all earlier ones.
    """
    schema = f"{HISTORY}, batch_id bigint"
    upto = _merged_upto(spark, root)
    recent = _read(spark, f"{root}/history", schema, basePath=f"{root}/history")
    if upto is None:
        return recent
    merged = spark.read.schema(schema).parquet(f"{root}/merged/upto={upto}")
    if recent is None:
        return merged
    return merged.unionByName(recent.filter(F.col("batch_id") > upto))


def _read(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame | None:
    """The Parquet table at ``path``, None if there is none."""
    try:
        return spark.read.schema(schema).options(**options).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _children(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []


def _merged_upto(spark: SparkSession, root: str) -> int | None:
    """The last batch of the newest complete merged file."""
    whole = [
        int(name.removeprefix("upto="))
        for name in _children(spark, f"{root}/merged")
        if name.startswith("upto=") and "_SUCCESS" in _children(spark, f"{root}/merged/{name}")
    ]
    return max(whole, default=None)


def _record(spark: SparkSession, root: str, batch_id: int, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, HISTORY).coalesce(1).write.mode("overwrite").parquet(
        f"{root}/history/batch_id={batch_id}"
    )


def _merge_history(spark: SparkSession, root: str, batch_id: int) -> None:
    """Every MERGE_EVERY batches the rows so far become one file; what it replaces is deleted after it is there."""
    if batch_id < 0 or (batch_id + 1) % MERGE_EVERY:
        return
    before = _merged_upto(spark, root)
    if before is not None and before >= batch_id:
        return  # a replay
    rows = sync_history(spark, root).filter(F.col("batch_id") <= batch_id)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/merged/upto={batch_id}")
    for name in _children(spark, f"{root}/history"):
        if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) <= batch_id:
            remove_path(spark, f"{root}/history/{name}")
    if before is not None:
        remove_path(spark, f"{root}/merged/upto={before}")


def _point(spark: SparkSession, root: str, batch_id: int, path: str, before: str | None) -> None:
    """The state after this batch, and that before it, for a replay.  Two files take turns, so one is always whole."""
    row = spark.createDataFrame([(batch_id, path, before)], POINTER)
    row.coalesce(1).write.mode("overwrite").json(f"{root}/current/turn={batch_id % 2}")


def initialise(state: State, root: str) -> None:
    """Write the state the stream starts from."""
    spark = state.nodes.sparkSession
    path = os.path.join(root, "state", f"batch-{INITIAL_BATCH}-step-0")
    write_state(state, path)
    _record(spark, root, INITIAL_BATCH, [(0, "initial", path, 0, 0, 0, 0, 0, 0, False, None, None)])
    _point(spark, root, INITIAL_BATCH, path, None)


def current_state_path(spark: SparkSession, root: str, before: int) -> str:
    """Where the newest state written by a batch earlier than ``before`` lies."""
    found = spark.read.schema(POINTER).json(f"{root}/current/turn=*").collect()  # two rows at most
    earlier = [(r["batch_id"], r["state_path"]) for r in found if r["batch_id"] < before]
    if earlier:
        return max(earlier)[1]
    # Both are of this batch or later ones, as when an old batch is replayed by hand.
    same = [r["before"] for r in found if r["batch_id"] == before]
    if same and same[0]:
        return same[0]
    history = sync_history(spark, root).filter(F.col("batch_id") < before)
    return history.agg(F.max_by("state_path", F.struct("batch_id", "step"))).first()[0]


def apply_manifests(spark: SparkSession, manifests: list, root: str, batch_id: int, keys: Keys) -> None:
    """Reconcile with each manifest's snapshot in turn.

    A snapshot that cannot be read (no such path, other columns) is recorded and
    skipped.  Any other failure fails the batch, which the stream then replays.
    Lists are derived from the snapshot's edges; where it brings lists of its own,
    the history counts those that differ from the stored ones.
    """
    path = before = current_state_path(spark, root, batch_id)
    rows = []
    for step, manifest in enumerate(manifests):
        counters, changed, error, lists_changed = (0,) * len(COUNTERS), False, None, None
        try:
            nodes = scan_node_snapshot(spark, f"{manifest['path']}/nodes")
            edges = scan_edge_snapshot(spark, f"{manifest['path']}/edges")
        except AnalysisException as problem:  # the stream goes on; the reason is in the history
            error = f"{type(problem).__name__}: {problem}"
        else:
            target = os.path.join(root, "state", f"batch-{batch_id}-step-{step}")
            old = read_state(spark, path)
            lists = _given_lists(spark, f"{manifest['path']}/adjacency")
            if lists is not None:
                lists_changed = adjacency_changed(old.adjacency, lists, ["node_id", "piece"]).count()
            _, summary = sync_apply(old, nodes, edges, keys, target)
            found = summary.first()
            if found["changed"]:
                path = target
            counters, changed = tuple(found[c] for c in COUNTERS), found["changed"]
        rows.append((step, manifest["snapshot_id"], path, *counters, changed, error, lists_changed))
    _record(spark, root, batch_id, rows)
    _point(spark, root, batch_id, path, before)
    _merge_history(spark, root, batch_id)


def _given_lists(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot's neighbour lists, None if it has none."""
    try:
        return scan_list_snapshot(spark, path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def start_sync(
    spark: SparkSession, manifests: str, root: str, keys: Keys, interval: str | None = "10 seconds"
) -> StreamingQuery:
    """Start the stream; ``interval=None`` processes what is there and stops."""
    stream = spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", 1).json(manifests)

    def batch(rows: DataFrame, batch_id: int) -> None:
        # A file of manifests names a few snapshots; one that names more is a mistake.
        found = rows.orderBy(F.col("sequence").asc_nulls_first(), "snapshot_id").limit(MOST_MANIFESTS + 1).collect()
        if len(found) > MOST_MANIFESTS:
            raise ValueError(f"a file names more than {MOST_MANIFESTS} snapshots")
        apply_manifests(rows.sparkSession, found, root, batch_id, keys)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint")
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()
