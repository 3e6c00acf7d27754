"""Near-duplicate join on word shingles: exact Jaccard links, and their components.

1. Every text becomes a set of 64-bit shingle hashes.  Equal sets are one class,
   whose least id stands for all; copies are never compared.
2. Exact prefix blocking.  All shingles have one order; sets that link must
   share one of their first ``n - need + 1``.  Order: shingles of the pool (a
   share of all, by hash) that only one class has, then the pool's others by how
   many have them, then all other shingles by hash.  So only the pool is counted,
   and a passage common to many documents comes late in the order.  Most
   documents have enough shingles of their own and can link with nothing.
3. Leaders.  Each class follows the least class of most of its blocking shingles.
   A leader and up to ``CHUNK_RECORDS`` followers are a unit, in which signature
   trees are traversed together (``signature_tree``) and what they do not prune
   is compared exactly.  So a family of m near copies costs m records and a
   leader per unit, and is one component of what its units find.
4. A blocking shingle is settled when all its classes are in one component
   already, or were all in one unit.  Every link that is still missing lies in a
   connected block of classes that share a shingle left open; it lies between
   two components, so a block is compared across components only.
5. A block larger than a cell is cut into cells by component (the largest one and
   the others), size class and hash; each pair of cells whose sizes can link is
   a unit, but for pairs within the largest component.
6. The links' spanning edges are merged into components.

Nothing is sampled or capped: every stage is an exact cover of the links.  Two
different shingles with one hash would count as one; with 64 bits that is not
expected at any size a document has.

Defined results: a null or empty text, or one without words, has an empty set
and links with nothing; fewer words than a shingle has make one shingle of the
whole; rows that share an id are one node with the links of each; a row without
an id links with nothing and has no component; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.base import small_batches, text_of
from veilgraph.llm.components import connected_components
from veilgraph.llm.signature_tree import UnionFind, least_overlap, link, overlap
from veilgraph.operators.skew import Dimension, attach
from veilgraph.runtime import keep, save, scratch

POOL_OF = 16
CHUNK_RECORDS = 250
CELL_RECORDS = 2000
CELL_MEMBERS = 1_000_000
MAX_TABLE_WORDS = 400_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
# Odd constants of the mixing steps.
_A, _B, _C = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class WordHashes(dict):
    """64-bit hash of each word, kept for words met before; bounded."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= MAX_TABLE_WORDS:
                self.clear()
            self[word] = value
        return value


_HASHES = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``words`` words."""
    known = _HASHES
    hashes = np.array([known[w] for w in _WORD.findall(text.translate(_LOWER))], np.uint64)
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    total = np.full(len(hashes) - size + 1, np.uint64(size)) * _C
    for k in range(size):
        total = _mix(total * _B + hashes[k : len(hashes) - size + 1 + k])
    return np.unique(total)


def pool_size(percent: int) -> int:
    """Sixteenths of all shingles that are counted: half as much again as a prefix takes."""
    return min(POOL_OF, -(-155 * (100 - percent) * POOL_OF // 10_000))


def in_pool(members: np.ndarray, percent: int) -> np.ndarray:
    return (members >> np.uint64(8)) % np.uint64(POOL_OF) < pool_size(percent)


def prefix_length(size: int, percent: int) -> int:
    """First shingles of which a set shares one with any set that it links with."""
    return size - -(-size * percent // 100) + 1


def _keys(members: np.ndarray, percent: int) -> tuple[list[int], int, list[int]]:
    """What is counted of a set: its shingles of the pool, and further first ones where these are too few."""
    pooled = in_pool(members, percent)
    pool, rest = members[pooled], members[~pooled]
    more = max(0, prefix_length(len(members), percent) - len(pool))
    return pool.view(np.int64).tolist(), len(pool), rest[:more].view(np.int64).tolist()


@dataclass(frozen=True)
class Joined:
    """``classes``: (doc_id, n_shingles, class_id) of each row; ``components``: (id, label) of linked classes."""

    classes: DataFrame
    components: DataFrame


def jaccard_join(docs: DataFrame, words: int = 3, percent: int = 90, column: str = "text") -> Joined:
    """Links between documents of which the shingle sets have a Jaccard similarity of ``percent`` or more."""
    spark = docs.sparkSession
    small_batches(spark)
    taken = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(column).alias("text"))

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                members = shingle_set(text, words)
                pool, n_pool, more = _keys(members, percent) if len(members) else ([], 0, [])
                rows.append((len(members), xxhash.xxh128_hexdigest(members.tobytes()), n_pool, pool, more))
            out = pd.DataFrame(rows, columns=["n", "content", "n_pool", "pool", "more"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    # Ids as text on the way: a column of ids with a null would reach pandas as floats.
    sets = taken.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        described, "doc_id string, n bigint, content string, n_pool int, pool array<bigint>, more array<bigint>"
    )
    with scratch(spark):
        sets = keep(save(sets.withColumn("doc_id", F.col("doc_id").cast("bigint")), "shingle-sets"))
        full = sets.filter("n > 0 AND doc_id IS NOT NULL")
        contents = full.groupBy("content").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
        contents = keep(save(contents, "contents"))
        # A class is described by its least id's row.
        least = contents.select(F.col("content").alias("_content"), F.col("class_id").alias("_id"))
        classes = full.join(least, (F.col("content") == F.col("_content")) & (F.col("doc_id") == F.col("_id")))
        # Written, so that the arrays are shuffled once for the three uses below.
        classes = classes.dropDuplicates(["doc_id", "content"]).select("doc_id", "n", "n_pool", "pool", "more")
        classes = save(classes, "classes")
        sizes = full.select(F.col("doc_id").alias("id"), "n")
        keyed = key_leaders(blocking_keys(classes, percent))
        placed = leader_places(keyed, sizes)
        links = unit_edges(taken, leader_units(placed), words, percent, "leader-links")
        components = connected_components(links)
        named = named_places(placed, components)
        left = open_keys(keyed, named)
        if not left.isEmpty():
            blocks = connected_components(star_edges(left))
            units = block_units(blocks, named, sizes, percent)
            more = unit_edges(taken, units, words, percent, "block-links")
            components = connected_components(links.unionByName(more))
        components = keep(save(components, "components"))

    dim = Dimension.of(contents, "content", "copies")
    scatter = F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string"))
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("content")).alias("content"))
    named = attach(rows, "content", dim, {"class_id": "class_id"}, scatter)
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return Joined(named.select("doc_id", "n_shingles", class_id.alias("class_id")), components)


def blocking_keys(classes: DataFrame, percent: int) -> DataFrame:
    """(doc_id, key) for those first shingles of each class that another class has counted too."""
    counted = classes.select("doc_id", F.explode(F.concat("pool", "more")).alias("key"))
    shared = save(counted.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "shared-keys")
    hits = counted.join(shared, "key")
    pooled = F.pmod(F.shiftrightunsigned("key", 8), F.lit(POOL_OF)) < pool_size(percent)
    per_class = hits.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(pooled, F.struct("df", "key")))).alias("_pool"),
        F.collect_list(F.when(~pooled, F.col("key"))).alias("_more"),
    )
    size = F.col("n")
    prefix = size - F.ceil(size * percent / 100).cast("bigint") + 1
    # Unique shingles of the pool come first; the shared ones fill what is left of the prefix.
    room = (prefix - (F.col("n_pool") - F.size("_pool"))).cast("int")
    described = per_class.join(classes.select("doc_id", "n", "n_pool"), "doc_id").filter(room > 0)
    chosen = F.transform(F.slice("_pool", F.lit(1), F.greatest(room, F.lit(0))), lambda x: x["key"])
    every = F.when(room > F.size("_pool"), F.concat(chosen, "_more")).otherwise(chosen)
    found = described.select("doc_id", F.explode(every).alias("key"))
    return save(found, "blocking-keys")


def key_leaders(keys: DataFrame) -> DataFrame:
    """(doc_id, key, lead): the least class of each blocking key, for keys that several classes have."""
    least = keys.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("_n")).filter("_n > 1")
    return save(keys.join(least.drop("_n"), "key").select("doc_id", "key", "lead"), "key-leaders")


def _parts(rows: Column, members: Column, most: int) -> Column:
    """Parts of about ``most`` records and CELL_MEMBERS shingles at most."""
    return F.greatest(F.lit(1), F.ceil(rows / most), F.ceil(members / CELL_MEMBERS)).cast("int")


def leader_places(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, lead, chunks, chunk): whom each class follows and in which unit; a class that leads itself has no chunk."""
    votes = keyed.groupBy("doc_id", "lead").agg((-F.count("*")).alias("_votes"))
    best = votes.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct("_votes", "lead")).alias("_best"))
    largest = sizes.groupBy("id").agg(F.max("n").alias("n"))
    chosen = save(best.join(largest, "id").select("id", F.col("_best.lead").alias("lead"), "n"), "leaders")
    load = chosen.filter("id <> lead").groupBy("lead")
    load = load.agg(_parts(F.count("*"), F.sum("n"), CHUNK_RECORDS).alias("chunks"))
    chunk = F.when(F.col("id") != F.col("lead"), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    return save(chosen.join(load, "lead", "left").select("id", "lead", "chunks", chunk.alias("chunk")), "leader-places")


def leader_units(placed: DataFrame) -> DataFrame:
    """Units of ``unit_edges``: the followers of a leader in chunks, the leader in each of them."""
    followers = placed.filter("id <> lead").select(F.col("lead").alias("block"), "chunk", "id")
    heads = followers.select("block", "chunk").distinct().withColumn("id", F.col("block"))
    cell = F.col("chunk").cast("string")
    units = followers.unionByName(heads)
    return units.select("block", cell.alias("low"), cell.alias("high"), cell.alias("cell"), "id", F.col("id").alias("label"))


def named_places(placed: DataFrame, components: DataFrame) -> DataFrame:
    """``placed`` with the component (label) that the leaders' units gave each class."""
    known = components.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    named = placed.join(known, F.col("id") == F.col("_id"), "left")
    return save(named.select("id", "lead", "chunk", F.coalesce("_label", "id").alias("label")), "named-places")


def open_keys(keyed: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, key) of keys whose classes are in several components and were not all in one unit.

    A leader is in every unit of its own, so its missing chunk does not count.
    """
    rows = keyed.select("doc_id", "key").join(named, F.col("doc_id") == F.col("id"))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("label", "lead", "chunk") for f in (F.min, F.max)]
    apart = "min_label <> max_label AND (min_lead <> max_lead OR min_chunk <> max_chunk)"
    left = rows.groupBy("key").agg(*ends).filter(apart).select("key")
    return save(keyed.select("doc_id", "key").join(left, "key"), "open-keys")


def star_edges(keys: DataFrame) -> DataFrame:
    """(a, b): each class of a key and the key's least class; as many rows as there are keys, not pairs."""
    least = save(keys.groupBy("key").agg(F.min("doc_id").alias("b"), F.count("*").alias("_n")).filter("_n > 1"), "least")
    return keys.join(least, "key").select(F.col("doc_id").alias("a"), "b").distinct()


def size_class(n: Column, percent: int) -> Column:
    """Sets that link are of one class or of neighbouring ones."""
    if percent >= 100:
        return n.cast("int")
    # A little wider than the ratio of sizes, so that rounding moves no pair two classes apart.
    return F.floor(F.ln(n) / F.lit(math.log(100 / percent) * 1.000001)).cast("int")


def block_units(blocks: DataFrame, named: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Units of ``unit_edges`` that cover all pairs of a block that are in different components and of sizes that link."""
    # Rows of one id may differ in size: each size has its place.
    known = named.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    members = blocks.select("id", F.col("label").alias("block")).join(known, F.col("id") == F.col("_id"))
    members = members.select("id", "block", F.col("_label").alias("label")).join(sizes.distinct(), "id")
    members = save(members, "block-members")
    weights = members.groupBy("block").agg(_parts(F.count("*"), F.sum("n"), CELL_RECORDS).alias("cells"))
    weighed = save(members.join(weights, "block"), "block-weights")
    one = F.lit("0")
    small = weighed.filter("cells = 1").select("block", one.alias("low"), one.alias("high"), one.alias("cell"), "id", "label")

    large = weighed.filter("cells > 1").drop("cells")
    counts = large.groupBy("block", "label").agg(F.count("*").alias("_rows"))
    main = counts.groupBy("block").agg(F.max(F.struct("_rows", "label"))["label"].alias("_main"))
    parted = large.join(main, "block").withColumn("main", F.col("label") == F.col("_main")).drop("_main")
    parted = save(parted.withColumn("size", size_class(F.col("n"), percent)), "block-parts")
    groups = parted.groupBy("block", "main", "size").agg(_parts(F.count("*"), F.sum("n"), CELL_RECORDS).alias("cells"))
    groups = save(groups, "block-groups")
    own = parted.join(groups, ["block", "main", "size"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("cells")))
    near = F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))
    others = groups.select("block", F.col("main").alias("_main"), F.col("size").alias("_size"), F.col("cells").alias("_cells"))
    met = own.withColumn("_size", near).join(others, ["block", "_size"]).filter("NOT (main AND _main)")
    met = met.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))
    cell = F.concat_ws("/", F.col("main").cast("string"), "size", "part")
    other = F.concat_ws("/", F.col("_main").cast("string"), "_size", "_part")
    low, high = F.least(cell, other).alias("low"), F.greatest(cell, other).alias("high")
    return small.unionByName(met.select("block", low, high, cell.alias("cell"), "id", "label")).distinct()


def unit_edges(docs: DataFrame, units: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """(a, b): spanning edges, between labels, of the links within the units (block, low, high).

    ``units``: (block, low, high, cell, id, label); a unit is one cell, or two of which only pairs across count.
    Records of one label are known to be connected.
    """
    units = save(units, f"{name}-units")
    # The comparison lets Spark make a Bloom filter of the ids, see ``_filtered_scan``.
    texts = docs.join(units.filter("low <= high"), F.col("doc_id") == F.col("id"))
    texts = texts.select("block", "low", "high", "cell", "id", "label", "text")

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, rows = None, []
        for batch in batches:
            edges: list[tuple[int, int]] = []
            columns = zip(*(batch[c] for c in ("block", "low", "high", "cell", "id", "label", "text")))
            for block, low, high, cell, own, label, text in columns:
                if (block, low, high) != unit:
                    edges += unit_links(unit, rows, percent)
                    unit, rows = (block, low, high), []
                rows.append((int(label), cell, shingle_set(text, words)))
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(unit_links(unit, rows, percent), columns=["a", "b"], dtype="int64")

    # Units are spread by hash and lie one after the other within a partition.
    with _filtered_scan(docs.sparkSession):
        spread = texts.repartition("block", "low", "high").sortWithinPartitions("block", "low", "high", "id")
        return save(spread.mapInPandas(linked, "a bigint, b bigint"), name)


@contextmanager
def _filtered_scan(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside may drop rows of a scan of any size by a Bloom filter before they are shuffled.

    Spark does so by itself only for scans of many gigabytes.  Most texts are in
    no block; without the filter all of them would be shuffled.
    """
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "0b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unit_links(unit: tuple | None, rows: list[tuple[int, str, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Spanning edges between the labels of a unit's records (label, cell, set): within its cell, or between its two."""
    rows = [r for r in rows if len(r[2])]
    labels, sets = [r[0] for r in rows], [r[2] for r in rows]
    first_of = {label: i for i, label in reversed(list(enumerate(labels)))}
    if len(first_of) < 2:
        return []
    if len(rows) == 2 and unit[1] == unit[2]:
        both = overlap(sets[0], sets[1])
        return [tuple(labels)] if both >= least_overlap(len(sets[0]), len(sets[1]), percent) else []
    found = UnionFind(len(rows))
    for i, label in enumerate(labels):
        found.join(first_of[label], i)
    if unit[1] == unit[2]:
        link(sets, np.arange(len(rows)), None, percent, found)
    else:
        low = np.array([r[1] == unit[1] for r in rows])
        if low.any() and not low.all():
            link(sets, np.flatnonzero(low), np.flatnonzero(~low), percent, found)
    ends = ((label, labels[found.find(i)]) for i, label in enumerate(labels))
    return sorted({(a, b) for a, b in ends if a != b})


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 90, column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; the component is named by its least id."""
    joined = jaccard_join(docs, words, percent, column)
    named = joined.components.select(F.col("id").alias("class_id"), F.col("label").alias("_label"))
    return joined.classes.join(named, "class_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("_label", "class_id").alias("component_id")
    )
