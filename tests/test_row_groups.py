"""What a build holds in one task does not depend on the row groups of its input."""

from pyspark.sql import functions as F

from veilgraph.runtime import deal_rows
from veilgraph.sources import trade


def test_a_file_of_one_row_group_is_dealt_to_many_tasks(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(4000).withColumn("v", F.col("id") % 7).coalesce(1).write.parquet(path)
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    try:
        for wanted, parts in (("9", 9), ("5000", 200)):
            spark.conf.set(name, wanted)
            dealt = deal_rows(spark.read.parquet(path), "id", "v")
            sizes = [r[1] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
            assert dealt.rdd.getNumPartitions() == parts
            assert sum(sizes) == 4000 and max(sizes) < 4000 / parts * 3
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


TABLES = {
    "lineitem": ("l_orderkey bigint, l_suppkey bigint, l_partkey bigint", [(o, s, o + s) for o in range(20) for s in range(3)]),
    "orders": ("o_orderkey bigint, o_custkey bigint", [(o, o % 5) for o in range(20)]),
    "customer": ("c_custkey bigint, c_nationkey int", [(c, 0) for c in range(5)]),
    "supplier": ("s_suppkey bigint, s_nationkey int", [(s, 1) for s in range(3)]),
    "nation": ("n_nationkey int, n_regionkey int", [(0, 0), (1, 0)]),
}


def test_long_tables_are_dealt_before_anything_groups_them(spark, tmp_path, monkeypatch):
    for name, (schema, data) in TABLES.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    dealt = []
    monkeypatch.setattr(trade, "deal_rows", lambda rows, *keys: dealt.append(set(keys)) or deal_rows(rows, *keys))
    pairs = trade.trade_pairs(spark, str(tmp_path))
    assert dealt == [{"l_orderkey", "l_suppkey", "l_partkey"}, {"o_orderkey", "o_custkey"}]
    assert not [f for f in pairs.inputFiles() if "lineitem.parquet" in f or "orders.parquet" in f]
    assert pairs.count() == 60 + 60 + 20 + 5 + 3 + 20 + 1
