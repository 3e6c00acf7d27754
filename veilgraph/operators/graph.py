"""From pairs to a labelled graph: normalisation, degrees, roles, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions.roles import (
    LOWEST_PERCENTILE_ROLE,
    LOWEST_ROLE,
    NODE_CUTOFFS,
    PERCENTILE_ROLES,
    edge_role,
    modulo_label,
    node_role,
)
from veilgraph.operators.skew import Dimension, attach, with_positions
from veilgraph.runtime import save


@dataclass(frozen=True)
class Graph:
    """nodes (id, degree, label); edges (u, v, label, u_label, v_label, u_degree, v_degree), u < v."""

    nodes: DataFrame
    edges: DataFrame


def drop_self_loops(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("u") != F.col("v"))


def normalise_undirected(pairs: DataFrame) -> DataFrame:
    """One row (min, max) per pair."""
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def derive_nodes(edges: DataFrame) -> DataFrame:
    """The endpoints of the edges."""
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Undirected degree; also the node set, as only endpoints are nodes.  Combines before the shuffle."""
    return edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(
        F.count(F.lit(1)).alias("degree")
    )


def in_out_degrees(edges: DataFrame) -> DataFrame:
    """How often a node is the smaller (out) and the larger (in) endpoint, and the sum."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ends = F.array(
        F.struct(F.col("u").alias("id"), one.alias("o"), zero.alias("i")),
        F.struct(F.col("v").alias("id"), zero.alias("o"), one.alias("i")),
    )
    return (
        edges.select(F.inline(ends))
        .groupBy("id")
        .agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
        .withColumn("total_degree", F.col("out_degree") + F.col("in_degree"))
    )


def node_roles(edges: DataFrame, cutoffs=NODE_CUTOFFS, nodes: DataFrame | None = None) -> DataFrame:
    """(id, degree, label) of the endpoints, or of all given ``nodes`` (no edges: lowest role)."""
    counted = degrees(edges)
    if nodes is not None:
        counted = nodes.select("id").distinct().join(counted, "id", "left").withColumn(
            "degree", F.coalesce("degree", F.lit(0).cast("bigint"))
        )
    return counted.withColumn("label", node_role(F.col("degree"), cutoffs))


def attach_endpoint_labels(edges: DataFrame, nodes: DataFrame, dim: Dimension | None = None) -> DataFrame:
    """Add the role and degree of both endpoints; a missing node has the lowest role, degree 0.

    Hub nodes are looked up by broadcast, see ``skew.attach``.
    """
    dim = dim or Dimension.of(nodes, "id", "degree")
    scatter = F.xxhash64("u", "v")
    both = attach(edges, "u", dim, {"label": "u_label", "degree": "u_degree"}, scatter)
    both = attach(both, "v", dim, {"label": "v_label", "degree": "v_degree"}, scatter)
    zero = F.lit(0).cast("bigint")
    return both.withColumns(
        {
            "u_label": F.coalesce("u_label", F.lit(LOWEST_ROLE)),
            "v_label": F.coalesce("v_label", F.lit(LOWEST_ROLE)),
            "u_degree": F.coalesce("u_degree", zero),
            "v_degree": F.coalesce("v_degree", zero),
        }
    )


def edge_roles(edges: DataFrame, nodes: DataFrame, dim: Dimension | None = None) -> DataFrame:
    both = attach_endpoint_labels(edges, nodes, dim)
    return both.withColumn("label", edge_role(F.col("u_label"), F.col("v_label"))).select(
        "u", "v", "label", "u_label", "v_label", "u_degree", "v_degree"
    )


def build_graph(pairs: DataFrame, cutoffs=NODE_CUTOFFS, hub_rows: int | None = None) -> Graph:
    """Normalise, label and write the graph; an empty graph is an error."""
    edges = save(normalise_undirected(drop_self_loops(pairs)), "edges")
    if edges.isEmpty():
        raise ValueError("the input has no edges")
    nodes = save(node_roles(edges, cutoffs), "nodes")
    dim = Dimension.of(nodes, "id", "degree", hub_rows)
    return Graph(nodes, save(edge_roles(edges, nodes, dim), "labelled-edges", ("label",)))


def edge_label_distribution(edges: DataFrame) -> DataFrame:
    return edges.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def label_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements (nodes and edges) per label."""
    return nodes.select("label").unionByName(edges.select("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n")
    )


def node_roles_percentile(nodes: DataFrame) -> DataFrame:
    """Roles by exact degree percentiles.

    Degrees are counted first: there are at most sqrt(4E) different ones, so
    the percentile reads a small table, with the counts as frequencies.
    """
    names = [name for name, _ in PERCENTILE_ROLES]
    shares = F.array(*[F.lit(share) for _, share in PERCENTILE_ROLES])
    by_degree = nodes.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    cuts = by_degree.agg(F.percentile("degree", shares, F.col("n")).alias("cuts"))
    expr = None
    cut_values = cuts.scalar()
    for i, name in enumerate(names):
        reached = F.col("degree") >= F.get(cut_values, F.lit(i))
        expr = F.when(reached, F.lit(name)) if expr is None else expr.when(reached, F.lit(name))
    return nodes.select("id", "degree", expr.otherwise(F.lit(LOWEST_PERCENTILE_ROLE)).alias("label"))


def edge_labels_modulo(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", modulo_label(F.col("u"), F.col("v")).alias("label"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per figure (stat, value): sizes, labels in use, degrees, elements per label."""
    node_stats = nodes.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.max("degree").alias("max_degree"),
        F.round(F.avg("degree"), 2).alias("avg_degree"),
    )
    per_label = label_counts(nodes, edges)
    number = F.col("value").cast("double")
    tall = node_stats.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value"))
                    for s in ("nodes", "max_degree", "avg_degree")
                ]
            )
        )
    )
    sizes = edges.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("edges").alias("stat"), "value")
    labels = per_label.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("labels").alias("stat"), "value"
    )
    counts = per_label.select(
        F.concat(F.lit("label:"), "label").alias("stat"), F.col("n").cast("double").alias("value")
    )
    return tall.unionByName(sizes).unionByName(labels).unionByName(counts).select("stat", number.alias("value"))


def pick_by_degree_rank(nodes: DataFrame) -> DataFrame:
    """The nodes at the first, the n//4-th and the last place by (degree desc, id).

    The histogram of degrees (at most sqrt(4E) rows) tells which degree holds
    each place; only the nodes of those degrees are then put in order, by a
    distributed sort.
    """
    hist = nodes.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    through = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumn("upto", F.sum("n").over(through))
    total = hist.agg(F.sum("n")).scalar()
    wanted = F.array(
        F.struct(F.lit("high").alias("class"), F.lit(0).cast("bigint").alias("place")),
        F.struct(F.lit("mid").alias("class"), F.floor(total / 4).cast("bigint").alias("place")),
        F.struct(F.lit("low").alias("class"), (total - 1).cast("bigint").alias("place")),
    )
    picks = (
        ranked.withColumn("_w", F.explode(wanted))
        .select("degree", (F.col("upto") - F.col("n")).alias("_before"), "upto", "_w.class", "_w.place")
        .filter((F.col("place") >= F.col("_before")) & (F.col("place") < F.col("upto")))
        .select("degree", "class", (F.col("place") - F.col("_before")).alias("_at"))
    )
    picks = save(picks, "picks")  # three rows
    group = nodes.join(F.broadcast(picks.select("degree").distinct()), "degree", "left_semi")
    placed = with_positions(group.select("degree", "id"), ["id"], within=["degree"], name="_at")
    return placed.join(F.broadcast(picks), ["degree", "_at"]).select("class", "id", "degree")
