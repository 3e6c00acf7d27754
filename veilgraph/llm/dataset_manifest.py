"""Merkle manifest of a dataset as a persistent tree: a tampered leaf is a version that copies its ancestors only.

Leaves are the rows' hashes, in order of id within their group; two neighbours
make a parent (a last one alone makes one by itself) up to the group's subroot,
and the subroots, ordered by group, make the root in the same way.

The tree lies in aligned blocks of ``2 ** BLOCK_LEVELS`` leaves.  A block is
built by one task; its top is a leaf of the blocks above, which are built alike
until one node is left, so no task holds more than a block and the number of
rounds is the logarithm of the largest group to the base of a block's size.
Going down again, each block gets its shared path: the siblings of its top up
to the root.  In a block every tampered leaf then makes a version: new nodes for
its ancestors, all other nodes shared with the version before; above the block
the version goes on along the shared path.

Defined results: a row without an id comes first in its group and is never
tampered with; rows of one id are ordered by leaf, and rows that are equal in
everything are interchangeable; a null in a hashed column is hashed as ``-``; a
null text is not an empty text; the null group comes first; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.llm.runs import in_frames, runs_of
from veilgraph.operators.skew import with_positions
from veilgraph.runtime import keep, save, scratch

BLOCK_LEVELS = 12
TAMPER_MODULUS = 7
VERIFIED = [
    "doc_id string", "leaf string", "subroot string", "root string", "proof_sha256 string", "folded_root string",
    "verified boolean", "path array<string>", "version array<string>",
]
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_over(size: int) -> int:
    """Levels between ``size`` nodes and the one above them all."""
    return (size - 1).bit_length()


def fold(leaf: str, path: Sequence[str]) -> list[str]:
    """The nodes from the parent of ``leaf`` to the top of ``path``.

    A step of a path is ``L`` or ``R`` and the sibling on that side, or empty for a node without one.
    """
    nodes = []
    for step in path:
        if not step:
            leaf = digest(leaf)
        elif step[0] == "L":
            leaf = digest(step[1:], leaf)
        else:
            leaf = digest(leaf, step[1:])
        nodes.append(leaf)
    return nodes


class BlockTree:
    """The nodes of one aligned block, level by level; versions share them and add what they copy."""

    def __init__(self, leaves: list[str], levels: int):
        self.levels = [leaves]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, place: int) -> list[str]:
        """Steps from the leaf at ``place`` to the block's top."""
        steps = []
        for nodes in self.levels[:-1]:
            sibling = place ^ 1
            steps.append("" if sibling >= len(nodes) else ("L" if place & 1 else "R") + nodes[sibling])
            place >>= 1
        return steps

    def version(self, place: int, leaf: str) -> list[str]:
        """The ancestors that a version with ``leaf`` at ``place`` copies, lowest first; it shares the rest."""
        copied = []
        for nodes in self.levels[:-1]:
            sibling = place ^ 1
            if sibling >= len(nodes):
                leaf = digest(leaf)
            else:
                leaf = digest(nodes[sibling], leaf) if place & 1 else digest(leaf, nodes[sibling])
            copied.append(leaf)
            place >>= 1
        return copied


def _field(value: Column) -> Column:
    as_text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text)
    )


def manifest_leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, tampered): hashes of each row, ``tampered`` null where nothing is tampered with."""

    def leaf(n_chars: Column) -> Column:
        values = [n_chars if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS]
        return F.sha2(F.concat(*[_field(v) for v in values]), 256)

    lot = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_MODULUS
    # Groups in their order as text: the null one first, then bytewise.
    group = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("lang")))
    return docs.select(
        group.alias("grp"),
        "doc_id",
        leaf(F.col("n_chars")).alias("leaf"),
        F.when(lot == 0, leaf(F.col("n_chars") + 1)).alias("tampered"),
    )


def _by_block(rows: DataFrame) -> DataFrame:
    """Rows of a block in one partition and in order of ``pos``."""
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _with_block(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", height))


def _levels(size: float, height: int) -> int:
    return min(height, levels_over(int(size)))


def block_tops(nodes: DataFrame, height: int) -> DataFrame:
    """(grp, pos, size, digest) of the blocks' tops, as nodes of the layer above."""

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for run in runs_of(batches, ["grp", "block"]):
            size = run["size"][0]
            tree = BlockTree(run["digest"], _levels(size, height))
            yield run["grp"][0], run["block"][0], -(-size >> height), tree.top

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_frames(tops(batches), ["grp", "pos", "size", "digest"])

    rows = _by_block(_with_block(nodes.select("grp", "pos", "size", "digest"), height))
    return rows.mapInPandas(built, "grp string, pos bigint, size bigint, digest string")


def shared_paths(nodes: DataFrame, height: int) -> DataFrame:
    """(grp, pos, path, root) of every node (grp, pos, size, digest): its steps up to its group's root."""
    if nodes.filter("size > 1").isEmpty():
        return nodes.select("grp", "pos", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root"))

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for run in runs_of(batches, ["grp", "block"]):
            tree = BlockTree(run["digest"], _levels(run["size"][0], height))
            for place, pos in enumerate(run["pos"]):
                yield run["grp"][0], pos, run["block"][0], tree.path(place)

    def stepped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_frames(steps(batches), ["grp", "pos", "block", "path"])

    above = shared_paths(save(block_tops(nodes, height), "block-tops"), height)
    above = above.select(
        F.col("grp").alias("_grp"), F.col("pos").alias("_block"), F.col("path").alias("_path"), "root"
    )
    layer = _by_block(_with_block(nodes, height)).mapInPandas(
        stepped, "grp string, pos bigint, block bigint, path array<string>"
    )
    joined = layer.join(above, (F.col("grp") == F.col("_grp")) & (F.col("block") == F.col("_block")))
    return save(joined.select("grp", "pos", F.concat("path", "_path").alias("path"), "root"), "shared-paths")


def block_paths(leaves: DataFrame, height: int) -> DataFrame:
    """(grp, block, path, subroot, root): how each block of ``leaves`` goes on to the root of all groups."""
    tops = save(block_tops(leaves.withColumnRenamed("leaf", "digest"), height), "block-tops")
    within = save(shared_paths(tops, height), "in-group")
    subroots = within.filter("pos = 0").select(F.col("grp").alias("of"), F.col("root").alias("digest"))
    ranked = save(with_positions(subroots, ["of"]), "subroots")
    size = ranked.count()
    tops = ranked.select(F.lit("").alias("grp"), "pos", F.lit(size).cast("bigint").alias("size"), "digest", "of")
    over = shared_paths(tops, height).select("pos", F.col("path").alias("_path"), F.col("root").alias("top"))
    over = ranked.join(over, "pos").select(F.col("of").alias("grp"), "_path", "top")
    return within.join(over, "grp").select(
        "grp",
        F.col("pos").alias("block"),
        F.concat("path", "_path").alias("path"),
        F.col("root").alias("subroot"),
        F.col("top").alias("root"),
    )


def dataset_manifest(docs: DataFrame, nodes: bool = False, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``folded_root`` is the root of the version that the row's tampered leaf makes, or the untampered leaf folded
    along its path.  With ``nodes`` there are also ``path``, the steps from the leaf to the root, and ``version``,
    the nodes which that version copies, lowest first (null where nothing is tampered with).
    """
    types = VERIFIED if nodes else VERIFIED[:-2]

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for run in runs_of(batches, ["grp", "block"]):
            for row in _verified(run, block_levels):
                yield row[: len(types)]

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_frames(rows_of(batches), [t.split()[0] for t in types])

    with scratch(docs.sparkSession):
        leaves = save(manifest_leaves(docs), "leaves")
        order = [F.col("doc_id").asc_nulls_first(), "leaf"]
        placed = save(with_positions(leaves, order, within=["grp"], size="size"), "placed-leaves")
        heads = _heads(block_paths(placed, block_levels))
        rows = _by_block(heads.unionByName(_with_block(placed, block_levels), allowMissingColumns=True))
        found = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
            verified, ", ".join(types)
        )
        return keep(save(found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "manifest"))


def _heads(paths: DataFrame) -> DataFrame:
    """A block's path as the row before its leaves, so that it is not copied to each of them."""
    return paths.select("grp", "block", F.lit(-1).cast("bigint").alias("pos"), "path", "subroot", "root")


def _verified(run: dict[str, list], height: int) -> Iterator[tuple]:
    """Proof and version of each leaf of a block; its first row has the path above it."""
    above, subroot, root = list(run["path"][0]), run["subroot"][0], run["root"][0]
    leaves = run["leaf"][1:]
    tree = BlockTree(leaves, _levels(run["size"][1], height))
    for place, (doc_id, leaf, tampered) in enumerate(zip(run["doc_id"][1:], leaves, run["tampered"][1:])):
        path = tree.path(place) + above
        version = None
        if tampered is None:
            folded = (fold(leaf, path) or [leaf])[-1]
        else:
            copied = tree.version(place, tampered)
            version = copied + fold(copied[-1] if copied else tampered, above)
            folded = version[-1] if version else tampered
        proof = digest(*[step[1:] for step in path])
        yield doc_id, leaf, subroot, root, proof, folded, folded == root, path, version
