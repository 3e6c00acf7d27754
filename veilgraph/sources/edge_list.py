"""Text edge lists: one ``u v`` pair per line, ``#`` comments, blank lines, gzip or plain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.runtime import save

_INTEGER = r"^[+-]?[0-9]+$"


@dataclass(frozen=True)
class EdgeList:
    """Parsed pairs (u, v) and the lines that could not be used (line, reason)."""

    edges: DataFrame
    rejects: DataFrame


def _integer(token: Column) -> Column:
    return F.when(token.rlike(_INTEGER), token.try_cast("bigint"))


def parse_edge_lines(lines: DataFrame, mode: str = "strict", written: bool = False) -> EdgeList:
    """Parse a DataFrame with a ``value`` column.

    ``strict`` wants exactly two integers per line.  ``lenient`` ignores extra
    tokens and skips lines with fewer than two.  Lines that are neither usable
    nor skipped by the mode's rule are returned as rejects, never lost.  With
    ``written`` the parsed lines are written once, so that both read no line again.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"unknown mode {mode!r}")
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    tokens = (
        lines.select(text.alias("line"))
        .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
        .withColumn("_tokens", F.split("line", r"\s+"))
    )
    parsed = tokens.select(
        "line",
        F.size("_tokens").alias("_n"),
        _integer(F.get("_tokens", F.lit(0))).alias("u"),
        _integer(F.get("_tokens", F.lit(1))).alias("v"),
    )
    if mode == "lenient":
        parsed = parsed.filter(F.col("_n") >= 2)
        wrong_size = F.lit(False)
    else:
        wrong_size = F.col("_n") != 2
    usable = ~wrong_size & F.col("u").isNotNull() & F.col("v").isNotNull()
    reason = F.when(wrong_size, F.lit("token count")).when(~usable, F.lit("not an integer"))
    judged = parsed.select(F.when(reason.isNotNull(), F.col("line")).alias("line"), "u", "v", reason.alias("reason"))
    if written:
        judged = save(judged, "parsed-lines")
    return EdgeList(
        edges=judged.filter("reason IS NULL").select("u", "v"),
        rejects=judged.filter("reason IS NOT NULL").select("line", "reason"),
    )


def scan_edge_list(spark: SparkSession, path: str, mode: str = "strict", written: bool = False) -> EdgeList:
    """Read text files under ``path``; ``.gz`` files are unpacked by the codec, one task per file.

    The lines of a packed file are spread before they are parsed.
    """
    lines = spark.read.text(path)
    packed = any(name.endswith(".gz") for name in lines.inputFiles())
    return parse_edge_lines(lines.repartition(spark.sparkContext.defaultParallelism) if packed else lines, mode, written)
