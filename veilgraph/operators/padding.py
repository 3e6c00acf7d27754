"""Dummies and decoys: rows that hide how many rows a query really needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.arithmetic import doubled_size, padded_size
from veilgraph.operators.skew import MAX_HUBS, Dimension, attach, repeat_rows, with_positions
from veilgraph.runtime import save

# Positions in a block of the store, of which a window names those that it reaches.
WINDOW_BLOCK = 4096


def pad_table(counts: DataFrame, key: str, size=padded_size) -> DataFrame:
    """(key, r, p_r, dummies) from (key, r)."""
    return counts.select(key, "r", size(F.col("r")).alias("p_r")).withColumn(
        "dummies", F.col("p_r") - F.col("r")
    )


def dummy_entries(pads: DataFrame, key: str = "label") -> DataFrame:
    """(key, i, text): the dummy entries of every key."""
    text = F.concat(F.lit("__dummy_"), F.col("i").cast("string"), F.lit("__"), F.col(key).cast("string"))
    rows = repeat_rows(pads.select(key, "dummies"), F.col("dummies"), [key], written=True)
    return rows.select(key, "i", text.alias("text"))


def window_start(p_r: Column, total: Column, dummies: Column) -> Column:
    """First position of the decoys of a read of ``p_r`` rows."""
    return F.pmod(p_r * 7, F.greatest(F.lit(1).cast("bigint"), total - dummies))


def decoy_window(pads: DataFrame, key: str, store: DataFrame, total: int) -> DataFrame:
    """The store rows (dense ``pos``) that pad the read of each key: ``dummies`` rows from its start.

    Windows are written out as positions and joined on the position, so the join
    makes as many rows as there are decoys.  A position that very many windows
    share is looked up by broadcast.  The outer bounds of all windows are two
    scalars, so the scan skips what lies outside.
    """
    windows = save(_windows(pads, key, total), "windows")
    low, high = windows.agg(F.min("_from"), F.max(F.col("_from") + F.col("dummies"))).first()
    places = repeat_rows(windows, F.col("dummies"), [key], index="_i", written=True)
    places = save(places.select(key, (F.col("_from") + F.col("_i")).alias("pos")), "decoy-places")
    asked = places.groupBy("pos").agg(F.count(F.lit(1)).alias("_asked"))
    in_reach = store.filter((F.col("pos") >= (low or 0)) & (F.col("pos") < (high or 0)))
    found = save(in_reach.join(asked, "pos"), "decoy-rows")
    dim = Dimension.of(found, "pos", "_asked")
    scatter = -1 - F.pmod(F.xxhash64(key, "pos"), F.lit(1 << 62))
    columns = {c: c for c in store.columns if c != "pos"}
    # A store shorter than a window has no row for its last places.
    return attach(places, "pos", dim, columns, scatter).filter(F.col(next(iter(columns))).isNotNull())


def _windows(pads: DataFrame, key: str, total: int) -> DataFrame:
    return pads.filter(F.col("dummies") > 0).select(
        key, "dummies", window_start(F.col("p_r"), F.lit(total).cast("bigint"), F.col("dummies")).alias("_from")
    )


def few_decoy_windows(
    pads: DataFrame, key: str, store: DataFrame, total: int, low: int, high: int, reads: int
) -> DataFrame:
    """As ``decoy_window`` for ``pads`` of few keys, within [low, high): nothing is written or shuffled on the way.

    Windows are not written out as positions, which the planner would take for as few rows as there are windows and
    broadcast.  A window has a row for each block of the store that it reaches: at most MAX_HUBS rows for all ``reads``,
    and two more per key.  These are broadcast, and a row of the store is compared with the windows of its block.
    """
    block = max(WINDOW_BLOCK, -(-reads // MAX_HUBS))
    end = F.col("_from") + F.col("dummies")
    reached = F.sequence(_block_of(F.col("_from"), block), _block_of(end - 1, block))
    windows = _windows(pads, key, total).select(key, "_from", end.alias("_end"), F.explode(reached).alias("_block"))
    in_reach = store.filter((F.col("pos") >= low) & (F.col("pos") < high))
    found = in_reach.withColumn("_block", _block_of(F.col("pos"), block)).join(F.broadcast(windows), "_block")
    return found.filter((F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_end"))).select(key, *store.columns)


def _block_of(pos: Column, block: int) -> Column:
    return F.call_function("div", pos, F.lit(block).cast("bigint"))


def window_bounds(total: int) -> list[Column]:
    """Aggregates of pads (p_r, dummies): the first and the last position of all windows."""
    start = window_start(F.col("p_r"), F.lit(total).cast("bigint"), F.col("dummies"))
    some = F.col("dummies") > 0
    return [F.min(F.when(some, start)), F.max(F.when(some, start + F.col("dummies")))]


def decoy_copies(batch: DataFrame, key: str, order: list[str], size=doubled_size) -> DataFrame:
    """Pad each key's rows to ``size(r)`` by repeating them in turn: row ``i mod r`` is copy ``i``.

    Adds ``slot``: 0 for the row itself, 1.. for its copies.  A slot, not a
    made-up id, tells copies apart.
    """
    placed = with_positions(batch, order, within=[key], name="_at", size="_r").withColumn(
        "_more", size(F.col("_r")) - F.col("_r")
    )
    whole = F.expr("_more div _r")
    extra = F.when(F.col("_at") < F.expr("_more % _r"), 1).otherwise(0)
    return repeat_rows(placed, 1 + whole + extra, [key, "_at"], index="slot").drop("_r", "_more", "_at")


def overhead_by_label(counts: DataFrame) -> DataFrame:
    """(label, real, dummy, p_r, overhead_pct) from (label, r)."""
    return pad_table(counts, "label").select(
        "label",
        F.col("r").alias("real"),
        F.col("dummies").alias("dummy"),
        "p_r",
        F.round(F.col("dummies") * 100.0 / F.greatest(F.col("r"), F.lit(1)), 1).alias("overhead_pct"),
    )


def protect_stats(nodes: DataFrame, edges: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: encrypted elements, real and dummy index entries, storage ratio, labels."""
    return protect_stats_of(nodes.agg(F.count(F.lit(1))).scalar(), edges.agg(F.count(F.lit(1))).scalar(), counts)


def protect_stats_of(n_nodes: Column, n_edges: Column, counts: DataFrame) -> DataFrame:
    """``protect_stats`` where nodes and edges are counted already."""
    pads = pad_table(counts, "label").agg(
        F.sum("r").alias("total_real"), F.sum("dummies").alias("total_dummy"), F.count(F.lit(1)).alias("num_labels")
    )
    ratio = (F.col("total_real") + F.col("total_dummy")) / F.greatest(F.col("total_real"), F.lit(1))
    return pads.select(
        n_nodes.alias("enc_nodes"), n_edges.alias("enc_edges"), "total_real", "total_dummy",
        F.round(ratio, 3).alias("storage_ratio"), "num_labels",
    )


def volume_leak(counts: DataFrame) -> DataFrame:
    """Per label and scheme: rows read, and whether the observer learns the true size."""
    r = F.col("r").cast("bigint")
    schemes = F.array(
        F.struct(F.lit("padded").alias("scheme"), padded_size(r).alias("observed")),
        F.struct(F.lit("double").alias("scheme"), doubled_size(r).alias("observed")),
        F.struct(F.lit("plain").alias("scheme"), r.alias("observed")),
    )
    rows = counts.select("label", F.col("r").alias("r_true"), F.inline(schemes))
    return rows.withColumn("leaks_size", F.col("observed") == F.col("r_true"))
