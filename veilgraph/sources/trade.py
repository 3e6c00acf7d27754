"""A labelled graph over trade tables: who orders, supplies, ships and belongs where.

Every rule is linear in its table: nothing pairs up the members of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.operators.skew import Dimension, attach
from veilgraph.runtime import deal_rows, save

# First id of each entity kind.
CUSTOMER, SUPPLIER, PART, NATION, ORDER, REGION = (
    1_000_000_000, 2_000_000_000, 3_000_000_000, 4_000_000_000, 5_000_000_000, 6_000_000_000,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(base: int, column: str):
    """Node id of an entity: its key shifted into the id space of its kind."""
    return F.lit(base).cast("bigint") + F.col(column).cast("bigint")


def trade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (u, v) pairs, with repeats and in any direction."""
    # The long tables are dealt once, so that no task below depends on the row groups of their files.
    line = ("l_orderkey", "l_suppkey", "l_partkey")
    order = ("o_orderkey", "o_custkey")
    lineitem = save(deal_rows(table(spark, sf_dir, "lineitem").select(*line), *line), "lines")
    orders = save(deal_rows(table(spark, sf_dir, "orders").select(*order), *order), "orders")
    customer = table(spark, sf_dir, "customer")
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")

    # One row per order with lines; it serves two kinds of edges.  An order
    # with very many lines is looked up by broadcast and never becomes one join group.
    per_order = lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.min("l_suppkey").alias("first"), F.max("l_suppkey").alias("last")
    )
    shipped = save(
        per_order.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"), "shipped-orders"
    )
    bought = attach(
        lineitem,
        "l_orderkey",
        Dimension.of(shipped, "l_orderkey", "lines"),
        {"o_custkey": "o_custkey"},
        F.xxhash64("l_suppkey", "l_partkey"),
    ).filter(F.col("o_custkey").isNotNull())
    bought = bought.select(entity(CUSTOMER, "o_custkey").alias("u"), entity(SUPPLIER, "l_suppkey").alias("v"))
    co_shipped = shipped.select(entity(SUPPLIER, "first").alias("u"), entity(SUPPLIER, "last").alias("v"))
    supplied = lineitem.select(entity(SUPPLIER, "l_suppkey").alias("u"), entity(PART, "l_partkey").alias("v"))
    placed = orders.select(entity(CUSTOMER, "o_custkey").alias("u"), entity(ORDER, "o_orderkey").alias("v"))
    resident = customer.select(entity(NATION, "c_nationkey").alias("u"), entity(CUSTOMER, "c_custkey").alias("v"))
    based = supplier.select(entity(NATION, "s_nationkey").alias("u"), entity(SUPPLIER, "s_suppkey").alias("v"))
    # Each nation and the next one of its region.
    by_region = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    next_door = (
        nation.withColumn("_next", F.lead("n_nationkey").over(by_region))
        .filter(F.col("_next").isNotNull())
        .select(entity(NATION, "n_nationkey").alias("u"), entity(NATION, "_next").alias("v"))
    )
    parts = [bought, supplied, placed, resident, based, co_shipped, next_door]
    return reduce(DataFrame.unionByName, parts)
