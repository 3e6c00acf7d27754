"""From documents to training batches: classify, apply rules, drop near duplicates, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but
the last returns the columns it was given, for the documents it keeps.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.jaccard_join import near_duplicates
from veilgraph.llm.packing import pack
from veilgraph.llm.quality_model import fit_quality, score_quality
from veilgraph.llm.quality_rules import quality_rules
from veilgraph.llm.token_counts import token_counts
from veilgraph.runtime import save


def _whole_rows(docs: DataFrame) -> DataFrame:
    """(row, text): the row as given, so that an operator's columns cannot replace its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def _kept(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.filter(condition).select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, learnt from these documents' labels, takes for good.

    A null text counts as empty and has the score of the curve alone; equal texts have one score, so repeated rows
    go or stay together; rows without an id are scored and never learnt from; an empty table stays empty; columns
    named like a score are the documents' own and come back as they were.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs.select("doc_id", "text"), labels)
    return _kept(score_quality(_whole_rows(docs), model), F.col("predicted") == 1)


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule.

    A null or empty text has no words and goes; repeated rows go or stay together; ids play no part; an empty table
    stays empty; columns named like a count are the documents' own and come back as they were.
    """
    return _kept(quality_rules(_whole_rows(docs)), F.col("kept"))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of least id, of least text hash among equal ids.

    The stage takes shingles of five words and a similarity of 0.8.  A document is an id with a text: rows that
    share an id and are not alike all stay, of rows with equal id and text the least by their other columns stays.
    A row without an id takes part like others and gives way to one with an id.  Texts without words are alike to
    nothing and all stay.  An empty table stays empty; columns named like the operator's come back as they were.
    """
    node = "_node"
    while node in docs.columns:
        node = f"_{node}"
    # Equal rows are told from others that share the hash by id and a second hash where rows are removed.
    keyed = docs.withColumn(node, F.xxhash64("doc_id", "text"))
    found = near_duplicates(keyed.select(F.col(node).alias("doc_id"), "text"), words=5, percent=80)
    found = found.groupBy("doc_id", "component_id").agg(F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    ids = keyed.select(F.col(node).alias("node"), F.col("doc_id").alias("id")).groupBy("node").agg(F.min("id").alias("id"))
    members = save(found.withColumnRenamed("doc_id", "node").join(ids, "node"), "group-members")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("least")
    first = members.filter("n > 0").groupBy("component_id").agg(least).select(F.col("least.node").alias("node"))
    keepers = save(
        members.join(first.withColumn("first", F.lit(True)), "node", "left")
        .filter("first OR n = 0")
        .select(F.col("node").alias(node), (F.col("first").isNotNull() & (F.col("rows") > 1)).alias("several")),
        "keepers",
    )
    stay = keyed.join(keepers.filter("NOT several").select(node), node, "left_semi").drop(node)
    several = keepers.filter("several").select(node)
    if several.isEmpty():
        return stay
    # Whole rows are grouped only where rows are equal in id and text.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = keyed.join(several, node, "left_semi").groupBy(node, "doc_id", F.md5("text"))
    return stay.unionByName(again.agg(F.min(whole).alias("row")).select("row.*"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch, place, padding) of every document.

    Lengths are word pieces of ``piece_bpe_32k.model``.  A null or empty text has none and still gets a place;
    repeated rows and rows without an id each get a place of their own; ties are broken by id, then length; an
    empty table stays empty; other columns are ignored.
    """
    counted = token_counts(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return pack(counted.select("doc_id", "n_pieces"), F.col("n_pieces")).drop("n_pieces")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rule_filter),
    ("jaccard_join", near_duplicate_filter),
    ("packing", packing),
]

# A trained classifier cannot be put in SQL; the tests hold the stages against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
