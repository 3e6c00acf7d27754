"""Authenticated encryption and keyed tokens as built-in column expressions.

Keys live in one-row DataFrames and enter expressions as scalar subqueries:
a literal key would be printed by ``explain`` and kept in event logs.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Keys:
    """The three keys: record content, search token, index entry (32 bytes each)."""

    content: DataFrame
    token: DataFrame
    index: DataFrame

    @staticmethod
    def of(spark: SparkSession, content: bytes, token: bytes, index: bytes) -> "Keys":
        def holder(key: bytes) -> DataFrame:
            return spark.createDataFrame(pa.table({"key": pa.array([key], pa.binary())}))

        return Keys(holder(content), holder(token), holder(index))


def _value(key: DataFrame) -> Column:
    return key.select("key").scalar()


def seal(text: Column, key: DataFrame) -> Column:
    """AES-GCM with a fresh random nonce per row."""
    return F.aes_encrypt(text, _value(key), F.lit("GCM"))


def unseal(blob: Column, key: DataFrame) -> Column:
    """Plain text of a blob, NULL when its tag does not verify."""
    return F.try_aes_decrypt(blob, _value(key), F.lit("GCM")).cast("string")


def unseal_or_fail(blob: Column, key: DataFrame) -> Column:
    """Plain text of a blob; a tag that does not verify fails the job."""
    return F.aes_decrypt(blob, _value(key), F.lit("GCM")).cast("string")


def mask(text: Column, key: DataFrame) -> Column:
    """The same blob for the same text, for intermediate tables: short, repeated, and opened by ``unmask``."""
    return F.aes_encrypt(text, _value(key), F.lit("ECB"))


def unmask(blob: Column, key: DataFrame) -> Column:
    return F.aes_decrypt(blob, _value(key), F.lit("ECB")).cast("string")


def evaluated_once(value: Column, name: str) -> Column:
    """``value`` as a column that later filters cannot copy.

    A filter on a plain column is moved below its projection together with the
    column's expression, so the blob would be decrypted in the filter and again in
    the projection.  Generated rows are not moved past.
    """
    return F.explode(F.array(value)).alias(name)


def keyed_token(label: Column, key: DataFrame) -> Column:
    """Hex SHA-256 of key and label: the search token of a label."""
    return F.sha2(F.concat(_value(key), F.encode(label, "UTF-8")), 256)


def keyed_order(key: DataFrame, *parts: Column) -> Column:
    """A pseudo-random sort key that reveals nothing about the row without the key."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.sha2(F.concat(_value(key), F.encode(text, "UTF-8")), 256)


def fixed_width(text: Column, width: int) -> Column:
    """Text blank-padded to ``width`` bytes in UTF-8; longer text is left whole."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.octet_length(text), F.lit(0))))
