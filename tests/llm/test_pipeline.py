"""The pipeline's stages against plain versions, each on the rows that its predecessor kept."""

import corpus_pipeline
from pyspark.sql import functions as F
from veilgraph.llm import quality_model
from veilgraph.runtime import save

from .conftest import SF_DIR
from .test_exact_operators import plain_components, plain_counts


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "jaccard_join", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = save(stage(spark, docs, SF_DIR), name)
        assert after.columns == docs.columns
        kept[name] = (docs.collect(), after.collect())
        docs = after
    before, after = kept["quality_classifier"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    all_docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = quality_model.fit_quality(all_docs, labels)
    good, bad = model.compressors()
    for r in before:
        z = model.slope * quality_model.feature(r["text"] or "", good, bad) + model.offset
        assert (r in after) == (z >= -0.8472978603872034)  # log odds of 0.3
    before, after = kept["quality_rules"]
    for r in before:
        n, _, symbols, _, repeated = plain_counts(r["text"])
        if n < 50 or 100 * repeated > 50 * n or symbols > 0.1 * n:
            assert r not in after
    before, after = kept["jaccard_join"]
    groups = plain_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted({g[2] for g in groups})
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in packed) == sorted(r["doc_id"] for r in after)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF_DIR).collect()) == sorted(r["doc_id"] for r in after)


def test_odd_rows(spark, odd_docs, odd_rows):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, odd_docs, SF_DIR)
        assert found.columns == odd_docs.columns and found.schema == odd_docs.schema
        assert found.count() <= len(odd_rows)
    left = corpus_pipeline.near_duplicate_filter(spark, odd_docs, SF_DIR)
    kept = sorted(((r["doc_id"], r["text"]) for r in left.select("doc_id", "text").collect()), key=repr)
    texts = dict(odd_rows)
    wanted = [(i, texts[i]) for i in (1, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14)] + [(None, None)]
    assert kept == sorted(wanted, key=repr)
    assert corpus_pipeline.packing(spark, odd_docs, SF_DIR).count() == len(odd_rows)
    empty = odd_docs.filter(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0, name


def test_unlike_rows_of_one_id_stay(spark):
    one, other = "alpha beta gamma delta epsilon zeta", "one two three four five six"
    rows = [(7, one, "b"), (7, other, "x"), (7, one, "a"), (9, one, "x"), (None, one, "x"), (None, "lone words of no id here", "x")]
    rows += [(3, "", "x"), (3, "", "x"), (3, None, "x"), (1, "one two three four five six", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _node string")
    found = sorted(map(tuple, corpus_pipeline.near_duplicate_filter(spark, docs, SF_DIR).collect()), key=repr)
    wanted = [(7, one, "a"), (1, other, "x"), (None, "lone words of no id here", "x"), (3, "", "x"), (3, "", "x"), (3, None, "x")]
    assert found == sorted(wanted, key=repr)
