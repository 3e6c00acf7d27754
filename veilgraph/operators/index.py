"""Token-keyed label index with padded, shuffled, encrypted entries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.functions.arithmetic import from_base36, to_base36
from veilgraph.functions.crypto import (
    Keys, evaluated_once, fixed_width, keyed_order, keyed_token, mask, seal, unmask, unseal,
)
from veilgraph.operators.padding import dummy_entries, pad_table
from veilgraph.operators.skew import filter_by_keys, hub_bound, join_small
from veilgraph.runtime import OPEN_FILES, codec, keep, remove_path, save, scratch, setting

# So many asked tokens are also named in the scan, which then opens only their directories.
NAMED_TOKENS = 1000

# Rows of a label that are put in order by one task.
SLOT_ROWS = 250_000

# ``id``, ``u`` and ``v`` are found in entries of indexes written before ids were listed in ``i``.
ENTRY = "kind string, i string, id bigint, u bigint, v bigint"


@dataclass(frozen=True)
class LabelIndex:
    """entries (token, slot, ct) and sizes (token, p_r), each with a directory per token where they are written."""

    entries: DataFrame
    sizes: DataFrame
    entries_path: str | None = None
    sizes_path: str | None = None


ENTRIES_TABLE = "slot bigint, ct binary, token string"
SIZES_TABLE = "p_r bigint, token string"


def open_index(spark: SparkSession, entries_path: str, sizes_path: str) -> LabelIndex:
    """An index as written, by this session or another: an asked label opens its own directory.

    A token has one size for each of its segments.
    """
    entries = spark.read.schema(ENTRIES_TABLE).parquet(entries_path).select("token", "slot", "ct")
    sizes = spark.read.schema(SIZES_TABLE).parquet(sizes_path).groupBy("token").agg(F.sum("p_r").alias("p_r"))
    return LabelIndex(entries, sizes, entries_path, sizes_path)


def write_index(index: LabelIndex, path: str) -> LabelIndex:
    """Write an index as a whole below ``path`` and open it there."""
    for name, rows in (("index", index.entries), ("sizes", index.sizes)):
        writer = rows.write.mode("overwrite").option("compression", codec(rows.sparkSession)).partitionBy("token")
        with setting(rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
            writer.parquet(f"{path}/{name}")
    return open_index(index.entries.sparkSession, f"{path}/index", f"{path}/sizes")


def label_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The inverted index as rows (label, kind, id, u, v): kind 'v' for nodes, 'e' for edges."""
    null = F.lit(None).cast("bigint")
    node_rows = nodes.select("label", F.lit("v").alias("kind"), F.col("id"), null.alias("u"), null.alias("v"))
    edge_rows = edges.select("label", F.lit("e").alias("kind"), null.alias("id"), "u", "v")
    return node_rows.unionByName(edge_rows)


def filter_kind(entries: DataFrame, kind: str) -> DataFrame:
    """Only the node ('v') or the edge ('e') entries."""
    return entries.filter(F.col("kind") == kind)


def label_pads(histogram: DataFrame) -> DataFrame:
    """(label, r, p_r, dummies)."""
    return pad_table(histogram.groupBy("label").agg(F.count(F.lit(1)).alias("r")), "label")


def build_label_index(histogram: DataFrame, keys: Keys) -> LabelIndex:
    """Pad every label, encrypt each entry, give it a slot that says nothing about its kind, write.

    Entries are blank-padded to the longest of this build, so all blobs have one
    length.  An entry is sealed in the task that writes it, once: what is written holds
    tokens, slots and ciphertexts only.
    """
    with scratch(histogram.sparkSession):
        entries, sizes = label_index_rows(histogram, keys)
        sizes = keep(save(sizes, "label-index-sizes", ("token",)))
        entries = keep(save(entries, "label-index", ("token",)))
        return open_index(histogram.sparkSession, entries._written_path, sizes._written_path)


def label_index_rows(histogram: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """entries (token, slot, ct) and sizes (token, p_r) of ``build_label_index`` for a caller who writes each of them once.

    Entries are sealed where they are written; what they read lies in the caller's scratch scope.
    """
    token = keyed_token(F.col("label"), keys.token)
    pads = save(label_pads(histogram), "label-pads")
    null = F.lit(None).cast("bigint")
    real = histogram.withColumn("pad", F.lit(None).cast("string"))
    dummies = dummy_entries(pads).select(
        "label", F.lit("d").alias("kind"), null.alias("id"), null.alias("u"), null.alias("v"),
        F.col("i").cast("string").alias("pad"),
    )
    placed = _slotted(real.unionByName(dummies), pads, keys)
    ct = seal(fixed_width(_text(), _width(histogram, pads)), keys.index).alias("ct")
    return placed.select(token.alias("token"), "slot", ct), pads.select(token.alias("token"), "p_r")


def _slotted(rows: DataFrame, pads: DataFrame, keys: Keys) -> DataFrame:
    """``rows`` with their ``slot``: the dense place of a keyed hash among those of the label.

    Hashes are even, so equal ranges of them cut a label with more than ``SLOT_ROWS`` rows into even parts.  The rows
    before a part are counted first; a part is then one group of the only shuffle, which moves rows and no blobs.
    """
    order = keyed_order(keys.index, *[F.col(c) for c in ("label", "kind", "id", "u", "v", "pad")])
    first = F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint")
    bound = hub_bound(pads.agg(F.sum("p_r")).first()[0] or 0, SLOT_ROWS)
    # At most MAX_HUBS labels pass the bound.
    large = pads.filter(F.col("p_r") > bound).select("label", F.ceil(F.col("p_r") / bound).alias("_parts"))
    if large.isEmpty():
        cut = rows.withColumns({"_part": F.lit(0).cast("bigint"), "_before": F.lit(0).cast("bigint")})
    else:
        part = F.shiftright(first * F.col("_parts"), 32)
        counts = rows.join(F.broadcast(large), "label").groupBy("label", part.alias("_part")).agg(
            F.count(F.lit(1)).alias("_rows")
        )
        earlier = Window.partitionBy("label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.select("label", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
        before = save(before.withColumn("label", mask(F.col("label"), keys.index)), "slot-offsets")
        before = before.withColumn("label", unmask(F.col("label"), keys.index))
        cut = rows.join(F.broadcast(large), "label", "left").withColumn("_part", F.coalesce(part, F.lit(0))).drop("_parts")
        # A row per part: at most two for every ``bound`` rows.
        cut = cut.join(F.broadcast(before), ["label", "_part"], "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
    dealt = cut.repartition("label", "_part").withColumn("_order", order)
    place = F.row_number().over(Window.partitionBy("label", "_part").orderBy("_order")) - 1
    return dealt.withColumn("slot", F.col("_before") + place).drop("_part", "_before", "_order")


def _text() -> Column:
    """An entry in few bytes: its kind, and its ids (a dummy: its number) to base 36; the label is that of its token."""

    def short(name: str) -> Column:
        return F.coalesce(to_base36(F.col(name)), F.lit(""))

    kind = F.col("kind")
    ids = F.when(kind == "e", F.concat_ws(" ", short("u"), short("v"))).otherwise(short("id"))
    return F.to_json(F.struct("kind", F.when(kind == "d", short("pad")).otherwise(ids).alias("i")))


def _width(histogram: DataFrame, pads: DataFrame) -> int:
    """A length that no entry passes, from the least and the greatest numbers; no entry is built for it."""
    digits = {c: F.greatest(*[F.length(to_base36(f(c))) for f in (F.min, F.max)]) for c in ("id", "u", "v")}
    found = histogram.agg(*[F.coalesce(n, F.lit(0)).alias(c) for c, n in digits.items()]).first()
    dummy = pads.agg(F.length(to_base36(F.max("dummies")))).first()[0] or 0
    return len('{"kind":"e","i":""}') + max(found["id"], found["u"] + len(" ") + found["v"], dummy)


def append_to_index(index: LabelIndex, rows: DataFrame, keys: Keys) -> LabelIndex:
    """Add the entries ``rows`` (label, kind, id, u, v): a segment for each of their labels, padded by itself.

    The segment's files join those of its token, its size joins the sizes; no written file changes.  Slots go on
    after the last one, so they stay dense.
    """
    spark = rows.sparkSession
    fresh = build_label_index(rows, keys)
    before = index.sizes.select("token", F.col("p_r").alias("_before"))
    placed = fresh.entries.join(before, "token", "left").withColumn("slot", F.col("slot") + F.coalesce("_before", F.lit(0)))
    placed.select("slot", "ct", "token").write.mode("append").partitionBy("token").parquet(index.entries_path)
    fresh.sizes.write.mode("append").partitionBy("token").parquet(index.sizes_path)
    _remove(fresh)
    return open_index(spark, index.entries_path, index.sizes_path)


def merge_segments(index: LabelIndex, labels: DataFrame, keys: Keys) -> LabelIndex:
    """Rewrite the segments of ``labels`` (label) as one, padded as a whole; other directories stay as they are.

    Worth it for a label whose segments are padded for more than their sum needs, see ``ready_to_merge``.
    """
    found = index_lookup(index, labels, keys).drop("slot")
    fresh = build_label_index(found, keys)
    for rows, path in ((fresh.entries, index.entries_path), (fresh.sizes, index.sizes_path)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("token").parquet(path)
    _remove(fresh)
    return open_index(labels.sparkSession, index.entries_path, index.sizes_path)


def ready_to_merge(index: LabelIndex, labels: DataFrame, keys: Keys) -> DataFrame:
    """(label): the asked labels that are padded for more rows than one segment of theirs would be."""
    counts = index_lookup(index, labels, keys).groupBy("label").agg(F.count(F.lit(1)).alias("r"))
    needed = pad_table(counts, "label").select("label", F.col("p_r").alias("_needed"))
    return lookup_sizes(index, labels, keys).join(needed, "label").filter(F.col("p_r") > F.col("_needed")).select("label")


def _remove(index: LabelIndex) -> None:
    for path in (index.entries_path, index.sizes_path):
        remove_path(index.entries.sparkSession, path)


def open_entries(entries: DataFrame, keys: Keys) -> DataFrame:
    """Decrypt index entries and keep the real ones: ``ct`` becomes kind, id, u, v."""
    kept = [c for c in entries.columns if c != "ct"]
    record = F.from_json(unseal(F.col("ct"), keys.index), ENTRY)
    opened = entries.select(*kept, evaluated_once(record, "_e")).filter(F.col("_e.kind").isin("v", "e"))
    ids = F.split("_e.i", " ", 2)

    def listed(name: str, kind: str, place: int) -> Column:
        own = F.when(F.col("_e.kind") == kind, from_base36(F.get(ids, F.lit(place))))
        return F.coalesce(own, F.col(f"_e.{name}")).alias(name)

    return opened.select(*kept, "_e.kind", listed("id", "v", 0), listed("u", "e", 0), listed("v", "e", 1))


def fetch_entries(index: LabelIndex, labels: DataFrame, keys: Keys) -> DataFrame:
    """All index rows (token, slot, ct) of the asked labels, real and dummy.

    A label may fill a third of the index: the short list of asked tokens is
    broadcast, the index is not shuffled.  A list of up to NAMED_TOKENS also
    prunes the directories that are opened.
    """
    tokens = save(asked_tokens(labels, keys).select("token"), "asked-tokens")
    named = [r["token"] for r in tokens.limit(NAMED_TOKENS + 1).collect()]
    entries = index.entries.filter(F.col("token").isin(named)) if len(named) <= NAMED_TOKENS else index.entries
    return join_small(entries, tokens, ["token"]).select("token", "slot", "ct")


def asked_tokens(labels: DataFrame, keys: Keys) -> DataFrame:
    """(label, token) of the distinct asked labels."""
    return labels.select("label").distinct().withColumn("token", keyed_token(F.col("label"), keys.token))


def with_label(rows: DataFrame, labels: DataFrame, keys: Keys) -> DataFrame:
    """Put the asked ``label`` in the place of ``token``."""
    return join_small(rows, asked_tokens(labels, keys), ["token"]).drop("token")


def index_lookup(index: LabelIndex, labels: DataFrame, keys: Keys) -> DataFrame:
    """The real entries (label, slot, kind, id, u, v) of the asked labels; unknown labels give none."""
    opened = open_entries(fetch_entries(index, labels, keys), keys)
    return with_label(opened, labels, keys).select("label", "slot", "kind", "id", "u", "v")


def lookup_sizes(index: LabelIndex, labels: DataFrame, keys: Keys) -> DataFrame:
    """(label, p_r) of the asked labels, 0 for unknown ones."""
    return asked_tokens(labels, keys).join(index.sizes, "token", "left").select(
        "label", F.coalesce("p_r", F.lit(0).cast("bigint")).alias("p_r")
    )


def rebuild_label_index(old: LabelIndex, histogram: DataFrame, touched: DataFrame, keys: Keys) -> LabelIndex:
    """Rebuild the entries of the ``touched`` labels (label) only; the other rows are taken as they are.

    A touched label without entries left disappears.
    """
    labels = save(touched.select("label").distinct(), "touched-labels")
    fresh = build_label_index(filter_by_keys(histogram, "label", labels), keys)
    tokens = save(labels.select(keyed_token(F.col("label"), keys.token).alias("token")), "touched-tokens")
    return LabelIndex(
        filter_by_keys(old.entries, "token", tokens, keep=False).unionByName(fresh.entries),
        filter_by_keys(old.sizes, "token", tokens, keep=False).unionByName(fresh.sizes),
    )
