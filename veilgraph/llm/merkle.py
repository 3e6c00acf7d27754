"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections.

A text is cut at blank lines into sections, at line ends into paragraphs and
after sentence marks into leaves (LEAF_CHARS code points at most).  Each node is
the SHA-256 of its children's, the root is the fingerprint: equal roots mean
equal texts, and where roots differ, the branches that differ lead to the edit.

All of it is one projection of array functions; nothing is exploded.  Comparing
a text with another needs that text's leaves only.

Two trees are compared from the top: sections with one hash at the same place
are equal and not looked into, then paragraphs of the others likewise, and only
the leaves of paragraphs that differ are compared as sets.

Defined results: a null text counts as empty; the empty text has one empty
section of one empty paragraph; equal texts have likeness 1, others less; rows
that share an id are documents of their own, in order of a hash of their text;
rows that are equal in id and text are one document, and each of them is
returned; rows without an id come after all others; a table of one document
compares it with itself; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.llm.base import bind, text_of
from veilgraph.operators.skew import with_positions
from veilgraph.runtime import save

LEAF_CHARS = 64
LEAF = r"[^.!?]{1,64}[.!?]*|[.!?]+"


def _node(level: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(level), F.array_join(children, "")), 256)


def merkle_tree(text: Column) -> Column:
    """Struct of ``root``, ``sections`` and ``paragraphs`` (hashes; paragraphs by section) and ``branches``.

    ``branches`` has a number of 60 bits for each node: sections of paragraphs of leaves.
    """

    def leaf_hashes(paragraph: Column) -> Column:
        pieces = F.regexp_extract_all(paragraph, F.lit(LEAF), 0)
        return F.transform(pieces, lambda p: F.sha2(F.concat(F.lit("l"), p), 256))

    leaves = F.transform(
        F.split(text, "\n\n"), lambda section: F.transform(F.split(section, "\n"), lambda p: leaf_hashes(p))
    )

    def above(found: Column) -> Column:
        paragraphs = F.transform(found, lambda s: F.transform(s, lambda p: _node("p", p)))
        return bind(paragraphs, lambda ps: topped(found, ps))

    def topped(found: Column, paragraphs: Column) -> Column:
        sections = F.transform(paragraphs, lambda s: _node("s", s))
        return bind(sections, lambda ss: whole(found, paragraphs, ss))

    def whole(found: Column, paragraphs: Column, sections: Column) -> Column:
        def paragraph(i: Column, j: Column) -> Column:
            leaves = F.transform(F.get(F.get(found, i), j), _number)
            return F.struct(_number(F.get(F.get(paragraphs, i), j)).alias("p"), leaves.alias("ls"))

        def section(s: Column, i: Column) -> Column:
            inside = F.transform(F.get(paragraphs, i), lambda _, j: paragraph(i, j))
            return F.struct(_number(s).alias("s"), inside.alias("ps"))

        return F.struct(
            _node("r", sections).alias("root"),
            sections.alias("sections"),
            paragraphs.alias("paragraphs"),
            F.transform(sections, section).alias("branches"),
        )

    return bind(leaves, above)


def _number(digest: Column) -> Column:
    """The first 60 bits of a hash."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _numbers() -> Column:
    return F.array().cast("array<bigint>")


def compared(a: Column, b: Column) -> Column:
    """Struct of ``same`` (leaves under equal branches), ``ours`` and ``theirs`` (other leaves) and ``places``.

    ``a`` and ``b`` are the branches of two trees; ``places`` are the differing paragraphs, as section.paragraph.
    """

    def leaf_count(section: Column) -> Column:
        return F.aggregate(section["ps"], F.lit(0), lambda n, p: n + F.size(p["ls"]))

    def of_paragraph(i: Column, j: Column, x: Column, y: Column) -> Column:
        equal = x["p"].eqNullSafe(y["p"])
        return F.struct(
            F.when(equal, F.size(x["ls"])).otherwise(F.lit(0)).alias("same"),
            F.when(equal, _numbers()).otherwise(F.coalesce(x["ls"], _numbers())).alias("ours"),
            F.when(equal, _numbers()).otherwise(F.coalesce(y["ls"], _numbers())).alias("theirs"),
            F.when(~equal, F.concat_ws(".", i.cast("string"), j.cast("string"))).alias("place"),
        )

    def of_section(i: Column, x: Column, y: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(x["ps"]), F.size(y["ps"])) - 1)
        inside = F.transform(places, lambda j: of_paragraph(i, j, F.get(x["ps"], j), F.get(y["ps"], j)))
        whole = F.array(
            F.struct(
                leaf_count(x).alias("same"), _numbers().alias("ours"), _numbers().alias("theirs"),
                F.lit(None).cast("string").alias("place"),
            )
        )
        return F.when(x["s"].eqNullSafe(y["s"]), whole).otherwise(inside)

    def summed(parts: Column) -> Column:
        return F.struct(
            F.aggregate(parts, F.lit(0), lambda n, p: n + p["same"]).alias("same"),
            F.array_distinct(F.flatten(F.transform(parts, lambda p: p["ours"]))).alias("ours"),
            F.array_distinct(F.flatten(F.transform(parts, lambda p: p["theirs"]))).alias("theirs"),
            F.array_join(F.transform(parts, lambda p: p["place"]), " ").alias("places"),
        )

    sections = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    return bind(F.flatten(F.transform(sections, lambda i: of_section(i, F.get(a, i), F.get(b, i)))), summed)


def likeness(root_a: Column, root_b: Column, found: Column) -> Column:
    """1 for equal texts; else twice the leaves in common over the leaves of both, below 1."""
    total = 2 * found["same"] + F.size(found["ours"]) + F.size(found["theirs"])
    both = 2 * found["same"] + 2 * F.size(F.array_intersect(found["ours"], found["theirs"]))
    share = F.when(total > 0, 1.0 * both / total).otherwise(F.lit(0.0))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(F.least(share, 1.0 - 1.0 / (total + 2)))


def edited_branches(a: Column, b: Column) -> Column:
    """Places (section, paragraph) from 0 where two trees differ; equal sections are not looked into."""

    def of_section(i: Column) -> Column:
        ours = F.coalesce(F.get(a["paragraphs"], i), F.array().cast("array<string>"))
        theirs = F.coalesce(F.get(b["paragraphs"], i), F.array().cast("array<string>"))
        places = F.sequence(F.lit(0), F.greatest(F.size(ours), F.size(theirs), F.lit(1)) - 1)
        differing = F.filter(places, lambda j: ~F.get(ours, j).eqNullSafe(F.get(theirs, j)))
        return F.transform(differing, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    places = F.sequence(F.lit(0), F.greatest(F.size(a["sections"]), F.size(b["sections"])) - 1)
    differing = F.filter(places, lambda i: ~F.get(a["sections"], i).eqNullSafe(F.get(b["sections"], i)))
    return F.flatten(F.transform(differing, of_section))


def next_documents(docs: DataFrame) -> DataFrame:
    """(doc, next_doc, copies): the document that follows in descending id, the first after the last.

    ``doc`` names an id with its text.  No text is moved.
    """
    ids = docs.select(_document(), "doc_id").groupBy("doc").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")
    )
    order = [F.col("doc_id").desc_nulls_last(), F.col("doc")]
    placed = save(with_positions(save(ids, "document-ids"), order, name="_pos"), "id-order")
    total = F.lit(max(placed.count(), 1))
    after = placed.select(F.pmod(F.col("_pos") - 1, total).alias("_pos"), F.col("doc").alias("next_doc"))
    return placed.join(after, "_pos").select("doc", "next_doc", "copies")


def _document() -> Column:
    return F.xxhash64("doc_id", text_of()).alias("doc")


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and the likeness to that and to the next document's text.

    The edited text has its last half (floor) of code points replaced by the next document's first as many;
    ``edited_branches`` names the paragraphs in which it differs.  Texts are shuffled once by their own document
    and once by the document before them.
    """
    follows = save(next_documents(docs), "next-ids")
    texts = docs.select("doc_id", _document(), text_of().alias("text"))
    owners = follows.select(F.col("doc").alias("_owner"), "next_doc")
    # With the id both joins move the same columns by the same key, so the texts are shuffled for them once.
    heads = texts.join(owners, F.col("doc") == F.col("next_doc")).select(
        "_owner", F.col("doc_id").alias("next_doc_id"), F.col("text").alias("_next")
    )
    if not follows.filter("copies > 1").isEmpty():
        heads = heads.dropDuplicates(["_owner"])  # rows equal in id and text are one document
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("_next"), F.lit(1), half)
    )
    # Trees are several times as large as what they are made from: they are built where both texts are.
    whole = (
        texts.join(heads, F.col("doc") == F.col("_owner"))
        .withColumn("_edited", edited)
        .withColumns({f"_tree{c}": merkle_tree(F.col(c)) for c in ("text", "_edited", "_next")})
        .withColumn("_with_edited", compared(F.col("_treetext.branches"), F.col("_tree_edited.branches")))
        .withColumn("_with_next", compared(F.col("_treetext.branches"), F.col("_tree_next.branches")))
    )
    mine = F.col("_treetext.root")
    return whole.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        mine.alias("fingerprint"),
        F.col("_tree_edited.root").alias("edited_fingerprint"),
        likeness(mine, F.col("_tree_edited.root"), F.col("_with_edited")).alias("near_edited"),
        likeness(mine, F.col("_tree_next.root"), F.col("_with_next")).alias("near_next"),
        F.col("_with_edited.places").alias("edited_branches"),
        "next_doc_id",
    )
