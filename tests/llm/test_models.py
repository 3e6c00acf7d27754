"""Trained operators: held-out accuracy, repeatability and odd rows."""

import time
import tracemalloc
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgraph.llm import boosted_trees, dom, html_pages, html_text, quality_model, toxicity
from veilgraph.llm.labelled import is_held_out, labelled_sample

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels")]


def held_out(scored, labels, label):
    rows = scored.filter("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    good = [r["score"] for r in rows if r[label] == 1]
    bad = [r["score"] for r in rows if r[label] == 0]
    ranks = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    return ranks, np.mean([r["predicted"] == r[label] for r in rows])


def test_quality_held_out(tables):
    docs, labels = tables
    model = quality_model.fit_quality(docs, labels)
    area, right = held_out(quality_model.score_quality(docs, model), labels, "quality")
    assert area > 0.9 and right > 0.85


def test_toxicity_held_out(tables):
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, labels)
    area, right = held_out(toxicity.score_toxicity(docs, model), labels, "toxic")
    assert area > 0.9 and right > 0.85


def test_held_out_labels_are_not_learnt(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(is_held_out(5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert labelled_sample(docs, labels, "quality", 5, 0, 50, 500) == labelled_sample(docs, flipped, "quality", 5, 0, 50, 500)


def test_one_text_of_each_labelled_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(k, "other") for k in range(2, 9)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)] * 3, "doc_id bigint, toxic int")
    rows, _ = labelled_sample(docs, labels, "toxic", 4, 9, 10, 50)
    assert len(rows) == 8 and ("text 0", 1) in rows


def plain_margins(model, text):
    """Margin of each span, from the n-grams one by one."""
    words = toxicity.words_of(text)
    values = []
    for word in words:
        _, buckets = toxicity.gram_table([word])
        values.append(sum(float(model.grams[b]) for b in buckets) / len(buckets))
    spans = [values[i : i + 3] for i in range(max(1, len(values) - 2))]
    return [sum(s) / len(s) + model.bias if s else model.bias for s in spans]


def test_every_span_is_scored():
    r = np.random.default_rng(1)
    model = toxicity.SubwordModel(r.normal(size=toxicity.BUCKETS).astype(np.float32), -0.5)
    table = toxicity.WordTable(model)
    texts = ["", "a", "a b", "vile elm Oun", "x " * 7 + "vile tig elm", *(" ".join(map(str, r.integers(0, 50, n))) for n in range(3, 40))]
    for text in texts:
        assert table.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-max(plain_margins(model, text)))), abs=1e-6)
        # A word in front changes no score but by its own spans.
        longer = max(plain_margins(model, "zz " + text))
        assert table.scores(["zz " + text])[0] == pytest.approx(1 / (1 + np.exp(-longer)), abs=1e-6)


def test_misspelt_words_share_grams():
    rows = [("the elm oun varo", 0), ("stil breth the tig", 0), ("varo stil oun elm", 0)] * 12
    rows += [("the elm wretched oun", 1), ("stil wretched tig", 1)] * 12
    model = toxicity.train(rows, 0.4)
    table = toxicity.WordTable(model)
    assert table.scores(["oun stil wretchedd elm"])[0] > 0.5 > table.scores(["oun stil breth elm"])[0]
    assert table.scores(["varo elm oun stil " * 3000 + "wretched"])[0] > 0.5  # a long text does not dilute a word


def test_spans_cover_every_word():
    for n in range(60):
        covered = {k for i in toxicity.span_starts(n) for k in range(i, min(i + toxicity.SPAN, n))}
        assert covered == set(range(n))


@pytest.mark.parametrize("fit,score", [
    (quality_model.fit_quality, quality_model.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity),
])
def test_odd_rows(spark, tables, odd_docs, odd_rows, no_docs, fit, score):
    model = fit(*tables)
    rows = score(odd_docs, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert all(r["held_out"] is False for r in rows if r["doc_id"] is None)
    empty = {r["score"] for r in rows if not r["text"]}
    assert len(empty) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert score(no_docs, model).count() == 0
    labels = spark.createDataFrame([(1, None, None)], "doc_id bigint, quality int, toxic int")
    assert len({r["score"] for r in score(odd_docs, fit(odd_docs, labels)).collect()}) == 1
    assert score(odd_docs, fit(no_docs, labels)).count() == len(odd_rows)


def test_boosted_trees_learn_an_interaction():
    r = np.random.default_rng(2)
    x = r.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.4)).astype(float)
    model = boosted_trees.fit(x[:2000], y[:2000], np.ones(2000), n_trees=30)
    assert np.mean((model.margin(x[2000:]) > 0) == y[2000:]) > 0.97


def test_made_up_pages_held_out():
    found, right = [], 0
    pages = html_pages.training_pages(80, seed=977)
    texts = html_text.extract([s for s, _ in pages], html_text.trained_model())
    for (source, labels), text in zip(pages, texts):
        wanted = "\n".join(dom.blocks(dom.read_page(source), labels))
        a, b = set(wanted.split("\n")), set(text.split("\n"))
        found.append(2 * len(a & b) / (len(a) + len(b)))
        right += wanted == text
    assert right >= 68 and np.mean(found) > 0.93


class Articles(HTMLParser):
    """Blocks of the article elements, by the standard library's parser."""

    INLINE = "a abbr b cite code em i mark q small span strong sub sup time u br".split()

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.now = 0, [], ""

    def cut(self):
        if self.now.split():
            self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now += " "
        elif tag not in self.INLINE:
            self.cut()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.cut()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.now += data


def test_given_pages(spark):
    """The pages' main text is known from their markup: it lies in the article element."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    rows = pages.collect()
    same = 0
    for r in rows:
        reader = Articles()
        reader.feed(r["html"])
        reader.close()
        same += texts[r["page_id"]] == "\n".join(reader.blocks)
    assert same == len(rows)


def test_formulas_and_fallback_text_stay():
    page = "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Areas</h1>"
    page += "<p>The area is <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> in the unit, as every reader of this page knows.</p>"
    page += "<p>See <object data=f.pdf>the table of figures</object> below, which has all that was measured.</p></article></body></html>"
    wanted = "Areas\nThe area is x = 2 in the unit, as every reader of this page knows.\n"
    wanted += "See the table of figures below, which has all that was measured."
    assert html_text.extract([page], html_text.trained_model()) == [wanted]


def test_elements_left_open_take_linear_time():
    began = time.process_time()
    html_text.extract(["<svg>" * 200_000 + "<p>a text</p>"], html_text.trained_model())
    assert time.process_time() - began < 5


def test_large_pages_take_bounded_memory():
    page = "<article>" + "<p>one paragraph</p>" * 500_000 + "</article>"
    model = html_text.trained_model()
    tracemalloc.start()
    text = html_text.extract([page], model)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text.count("\n") == 499_999 and peak < 900_000_000, peak


PAGES = [
    (None, ""), ("", ""), ("plain words only", None), ("<", None), ("<p", None), ("<!-- never", ""), ("<script>x", ""),
    ("<article><h1>A &amp; B</h1><p>One\n two&nbsp;three <b>four<br>five</p><p>Six.", "A & B\nOne two three four five\nSix."),
    ("</div></div><article><p>x</b> y</p></article></p>", "x y"),
    ("<a title='x>y'>" * 3, ""), ("<div " + 'a="' * 4000, ""), ("<p>" * 20_000, None), ("<div>" * 3000 + "deep", None),
]


def test_odd_pages(spark):
    rows = [(k, "u", h, "x") for k, (h, _) in enumerate(PAGES)] + [(None, None, None, "x")]
    found = html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars string"))
    texts = {r["page_id"]: r["text"] for r in found.collect()}
    for k, (_, wanted) in enumerate(PAGES):
        if wanted is not None:
            assert texts[k] == wanted, PAGES[k][0][:40]
    assert texts[None] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in found.collect())
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_text.main_text(empty).count() == 0
