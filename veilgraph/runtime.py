"""Session helpers and the one way this package cuts lineage: written tables.

Intermediate results that are used more than once, and every padded read, are
written to the shared folder the cluster names in ``spark.checkpoint.dir`` and
read back.  A written table survives the loss of an executor, and its real
size lets the planner choose a broadcast join only when the side is small.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Bytes of compressed input, or of a shuffle, for each task.
PARTITION_BYTES = 8 << 20
# Bytes of rows in memory for a byte of their file: ids in Zstandard take 2 to 3 bytes each, and 16 to 90 when they are broadcast.
IN_MEMORY = 16.0
# Files a task may have open at once while it writes to several directories; beyond that it sorts.
OPEN_FILES = 16

# Paths written in each open scratch scope of this thread or task, innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("veilgraph")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def fit_partitions(spark: SparkSession, *paths: str) -> None:
    """Let the tasks of this session grow in number, and not in size, with the files at ``paths``.

    The usual number of shuffle partitions is fixed, and merged ones may be as large as 64 MB compressed: ten million
    edges, which a task sorts on disk.  Adaptive execution still merges what turns out small.

    The planner takes the bytes of a file for those of its rows, and would have the driver collect and broadcast rows
    of many times its limit; it is told what they take in memory.
    """
    files = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    conf = spark._jsc.hadoopConfiguration()
    size = sum(f.getFileSystem(conf).getContentSummary(f).getLength() for f in files)
    default = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(default, -(-size // PARTITION_BYTES)))
    )
    for name, value in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION_BYTES),
                        ("spark.sql.files.maxPartitionBytes", 2 * PARTITION_BYTES),
                        ("spark.sql.sources.fileCompressionFactor", IN_MEMORY)):
        if spark.conf.get(name, None) is None:  # what the user chose stays
            spark.conf.set(name, str(value))


def deal_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` of a scan in as many even tasks as ``fit_partitions`` asks for, dealt by ``keys`` that seldom repeat.

    A scan has no more tasks than its files have row groups; a file with a single one is read by one task, and what
    that task groups grows with the file.  Up to the bound on parts, rows are written as they are read and none is
    held back or sorted.
    """
    spark = rows.sparkSession
    default = spark.conf.get("spark.sql.shuffle.partitions")
    wanted = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", default))
    bound = int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return rows.repartition(max(1, min(wanted, bound)), *keys)


def shared_dir(spark: SparkSession) -> str:
    """Folder for written tables: ``spark.checkpoint.dir``, seen by all executors.

    Where that is unset it is the SQL warehouse, which executors share as well; on a cluster it must not be a
    folder of one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if root.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir is unset, and {root} is not shared by the executors")
    return os.path.join(root, "veilgraph", spark.sparkContext.applicationId)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written table, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those handed to ``keep``.

    For work that ends in written tables: what it returns must not read the others.
    """
    mine: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in mine:
            remove_path(spark, path)


def _in_scope(path: str) -> None:
    scopes = _SCOPES.get()
    if scopes:
        scopes[-1].append(path)


def keep(table: DataFrame) -> DataFrame:
    """Take a table written in the innermost scratch scope out of it."""
    path, scopes = table._written_path, _SCOPES.get()
    if scopes and path in scopes[-1]:
        scopes[-1].remove(path)
        if len(scopes) > 1:
            scopes[-2].append(path)
    return table


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read a written table with the schema it was written with (no inference job)."""
    return spark.read.schema(like.schema).parquet(path)


def codec(spark: SparkSession) -> str:
    """The compression of written tables: Zstandard, which takes fewer bytes than Spark's default, or what the user chose."""
    return spark.conf.get("spark.sql.parquet.compression.codec", None) or "zstd"


def save(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and return the table read back.

    ``partition_by`` names columns with a small vocabulary; a filter on them
    then reads only their directories.
    """
    path = new_path(df.sparkSession, name)
    _in_scope(path)
    # Rows of a few directories go to a file of each; they are not sorted by directory first.
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES if partition_by else 0)):
        df.write.partitionBy(*partition_by).option("compression", codec(df.sparkSession)).parquet(path)
    table = read_table(df.sparkSession, path, df)
    table._written_path = path
    return table


def save_bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """Write ``df`` bucketed on ``keys``, so repeated joins on them move only the other side."""
    path = new_path(df.sparkSession, name)
    _in_scope(path)
    return write_bucketed(df, path, buckets, *keys)


def write_bucketed(df: DataFrame, path: str, buckets: int, *keys: str) -> DataFrame:
    """Write ``df`` to ``path``, one sorted file per bucket, and return the table read back."""
    write_dealt(df.repartition(buckets, *keys), path, buckets, *keys)
    return read_bucketed(df.sparkSession, path, df, buckets, *keys)


def write_dealt(df: DataFrame, path: str, buckets: int, *keys: str) -> None:
    """``write_bucketed`` for rows that are dealt to ``buckets`` tasks by ``keys``: they are not moved.

    A bucketed table is read by its buckets then, which Spark would not do for a mere copy.
    """
    spark, table = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
        (
            df.write.mode("overwrite")
            .bucketBy(buckets, *keys)
            .sortBy(*keys)
            .option("path", path)
            .option("compression", codec(spark))
            .saveAsTable(table, format="parquet")
        )
    spark.sql(f"DROP TABLE {table}")  # external: the files stay


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """One setting of the session for as long as a write takes."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def append_bucketed(df: DataFrame, path: str, buckets: int, *keys: str) -> None:
    """Add files for the rows of ``df`` to the buckets at ``path``; the files there stay as they are."""
    table = _name_bucketed(df.sparkSession, path, df, buckets, *keys)
    try:
        df.repartition(buckets, *keys).write.insertInto(table)
    finally:
        df.sparkSession.sql(f"DROP TABLE {table}")


def read_bucketed(spark: SparkSession, path: str, like: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """A table that ``write_bucketed`` wrote, maybe in another session.

    Files carry their bucket in their names; only the catalog tells Spark how many buckets there are, so the files
    are named there for as long as it takes to resolve the table.
    """
    table = _name_bucketed(spark, path, like, buckets, *keys)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    found._written_path, found._buckets = path, buckets
    return found


def _name_bucketed(spark: SparkSession, path: str, like: DataFrame, buckets: int, *keys: str) -> str:
    table = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet "
        f"CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return table
