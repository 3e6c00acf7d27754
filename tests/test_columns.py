"""Column expressions: padded sizes, tokens, roles, encryption."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from conftest import KEY_BYTES, rows
from veilgraph.functions.arithmetic import bench_worker_counts, padded_size, shard_size, workers_for
from veilgraph.functions.crypto import Keys, fixed_width, keyed_token
from veilgraph.functions.roles import edge_role, node_role
from veilgraph.operators.protect import NODE_RECORD, open_rows, protect_nodes, unprotect_rows
from veilgraph.runtime import save


def _pad(r):
    if r == 0:
        return 0
    share = 0.20 if r < 1000 else 0.15 if r < 5000 else 0.10
    return r + max(1, math.ceil(r * share))


def test_padded_size(spark):
    found = spark.range(0, 20000).select("id", padded_size(F.col("id")).alias("p")).collect()
    assert all(row.p == _pad(row.id) for row in found)


def test_workers(spark):
    found = spark.createDataFrame([(0,), (499,), (500,), (1999,), (2000,), (4999,), (5000,)], "r bigint")
    got = found.select("r", workers_for(F.col("r")), bench_worker_counts(F.col("r"))).collect()
    assert [tuple(x) for x in got] == [
        (0, 1, [1]), (499, 1, [1]), (500, 2, [1, 2]), (1999, 2, [1, 2]),
        (2000, 4, [1, 2, 4]), (4999, 4, [1, 2, 4]), (5000, 8, [1, 2, 4, 8]),
    ]
    assert found.select(shard_size(F.lit(10), F.lit(4))).first()[0] == 3


def test_roles(spark):
    degrees = spark.createDataFrame([(501,), (500,), (201,), (200,), (51,), (50,), (6,), (5,), (0,)], "d bigint")
    assert [r[0] for r in degrees.select(node_role(F.col("d"))).collect()] == [
        "Executive", "Manager", "Manager", "Employee", "Employee", "External", "External", "Inactive", "Inactive",
    ]
    pairs = spark.createDataFrame(
        [("Manager", "Executive"), ("Manager", "Employee"), ("Employee", "Manager"), ("Inactive", "Inactive"), ("External", "Inactive")],
        "a string, b string",
    )
    assert [r[0] for r in pairs.select(edge_role(F.col("a"), F.col("b"))).collect()] == [
        "REPLY", "BROADCAST", "SEND", "INTERNAL", "SEND",
    ]


def test_token_is_the_plain_digest(spark, keys):
    found = spark.createDataFrame([("Executive",), ("Größe",)], "label string")
    got = rows(found.select("label", keyed_token(F.col("label"), keys.token)))
    assert got == sorted(
        (label, hashlib.sha256(KEY_BYTES["token"] + label.encode()).hexdigest()) for label in ("Executive", "Größe")
    )


def test_fixed_width_keeps_long_text(spark):
    found = spark.createDataFrame([("a",), ("é",), ("b" * 200,)], "t string").select(fixed_width(F.col("t"), 96).alias("t"))
    assert sorted(len(r.t.encode()) for r in found.collect()) == [96, 96, 200]


def test_round_trip_and_wrong_key(spark, keys):
    nodes = spark.range(50).select("id", F.concat(F.lit("L"), F.col("id").cast("string")).alias("label"))
    blobs = save(protect_nodes(nodes, keys), "t")
    assert blobs.select("ct").distinct().count() == 50
    opened = unprotect_rows(blobs, keys, "ct", NODE_RECORD)
    assert opened.rejected.count() == 0
    assert rows(opened.rows.select("record.id", "record.label")) == rows(nodes)
    other = Keys.of(spark, b"x" * 32, b"y" * 32, b"z" * 32)
    wrong = unprotect_rows(blobs, other, "ct", NODE_RECORD)
    assert wrong.rows.count() == 0 and wrong.rejected.count() == 50
    with pytest.raises(Exception, match="AES_CRYPTO_ERROR"):
        open_rows(blobs, other, "ct", NODE_RECORD).collect()


def test_equal_plaintexts_have_different_blobs(spark, keys):
    same = spark.range(20).select(F.lit(1).cast("bigint").alias("id"), F.lit("a").alias("label"), F.col("id").alias("n"))
    assert save(protect_nodes(same, keys), "t").select("ct").distinct().count() == 20


def test_keys_are_not_in_plans(spark, keys, capsys):
    nodes = spark.range(5).select("id", F.lit("a").alias("label"))
    protect_nodes(nodes, keys).explain(True)
    text = capsys.readouterr().out
    key = KEY_BYTES["content"]
    assert "aesEncrypt" in text and key.decode() not in text and key.hex() not in text.lower()
    assert "[63, 63" not in text and "99, 99, 99" not in text


def test_a_blob_is_decrypted_once(spark, keys, capsys):
    nodes = spark.range(5).select("id", F.lit("a").alias("label"))
    blobs = save(protect_nodes(nodes, keys), "t")
    open_rows(blobs, keys, "ct", NODE_RECORD).filter("record.label = 'a'").select("record.id").explain()
    assert capsys.readouterr().out.count("aesDecrypt") == 1
