"""Operators with exact results against plain Python."""

import base64
import hashlib
import random
import re
import struct
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from veilgraph.llm import jaccard_join, merkle, packing, sentencepiece_ids, signature_tree, token_counts, warc
from veilgraph.llm.base import text_of, words_of
from veilgraph.llm.components import connected_components
from veilgraph.llm.quality_rules import Rule, quality_rules

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Quality rules


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd_docs, odd_rows):
    found = quality_rules(odd_docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = found.select("doc_id", "text", *names, "base_failed", "kept", "score").collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert tuple(r[n] for n in names) == plain_counts(r["text"]), r["doc_id"]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
        assert r["score"] == "x"


def test_colliding_windows_are_told_apart(spark, monkeypatch):
    """All windows have one of four hashes; the counts stay right."""
    from veilgraph.llm import quality_rules as module

    real = module.F.xxhash64

    class Functions:
        def __getattr__(self, name):
            return (lambda *c: real(*c) % 4) if name == "xxhash64" else getattr(F, name)

    monkeypatch.setattr(module, "F", Functions())
    r = random.Random(6)
    rows = [(i, " ".join(str(r.randrange(7)) for _ in range(r.randint(0, 120)))) for i in range(30)]
    found = quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [f["n_repeat_words"] for f in sorted(found, key=lambda f: f["doc_id"])] == [plain_counts(t)[4] for _, t in rows]


def test_rules_name_what_is_broken(spark):
    docs = spark.createDataFrame([(1, "a b c " * 40), (2, "# " * 60)], "doc_id bigint, text string")
    rules = [Rule("short", "word_chars", "n_words", low=3.0), Rule("symbols", "n_symbols", "n_words", high=0.5)]
    found = {r["doc_id"]: r["broken"] for r in quality_rules(docs, rules).collect()}
    assert found == {1: ["short"], 2: ["short", "symbols"]}


def test_quality_of_no_rows(no_docs):
    assert quality_rules(no_docs).count() == 0


# SentencePiece


def test_ids_are_the_librarys(spark, odd_docs, odd_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = sentencepiece_ids.encode_decode(odd_docs, MODEL).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        wanted = library.encode(r["text"] or "", add_eos=True)
        assert r["ids"] == wanted and r["n_tokens"] == len(wanted)
        assert r["decoded"] == library.decode(wanted)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, wanted)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(wanted).encode()).hexdigest()
        assert r["score"] == "x"


def test_chunk_table_on_random_texts(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = sentencepiece_ids.ChunkTable(MODEL)
    r = random.Random(5)
    parts = [" ", "  ", "\t", "\n", "▁", "a", "the", "é", "日", "😀", "</s>", "<0x41>", "�", "\xa0", "ing"]
    monkeypatch.setattr(sentencepiece_ids, "MAX_TABLE_CHARS", 60)  # the table is emptied again and again
    for _ in range(1500):
        text = "".join(r.choices(parts, k=r.randint(0, 14)))
        ids, n, raw = table.encode(text)
        wanted = library.encode(text, add_eos=True)
        assert (ids, n, raw.decode()) == (" ".join(map(str, wanted)), len(wanted), library.decode(wanted)), text


# Word-piece counts


def greedy(word, initial, following):
    at, count = 0, 0
    while at < len(word):
        known = initial if at == 0 else following
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 0
        at, count = end, count + 1
    return count


def test_automaton_is_greedy_longest_match():
    r = random.Random(8)
    for _ in range(60):
        def pieces(most):
            return {"".join(r.choices("abc", k=r.randint(1, 4))) for _ in range(r.randint(1, most))}

        initial, following = pieces(9), pieces(9)
        counter = token_counts.PieceCounter(initial, following)
        for _ in range(150):
            word = "".join(r.choices("abcd", weights=(6, 6, 6, 1), k=r.randint(1, 12)))
            assert counter.count(word) == greedy(word, initial, following), (word, initial, following)


def test_token_counts(odd_docs, odd_rows):
    initial, following = map(set, token_counts.piece_vocabulary(MODEL))
    rows = token_counts.token_counts(odd_docs, MODEL).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        if len(r["text"] or "") > 20_000:
            continue
        counts = [greedy(w, initial, following) for w in token_counts.WORD.findall(r["text"] or "")]
        assert (r["n_words"], r["n_unknown"]) == (len(counts), counts.count(0))
        assert r["n_pieces"] == sum(counts) + counts.count(0)


# Fingerprints


def plain_tree(text):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    sections = [
        [[sha("l" + piece) for piece in re.findall(merkle.LEAF, p)] for p in s.split("\n")] for s in text.split("\n\n")
    ]
    return sha("r" + "".join(sha("s" + "".join(sha("p" + "".join(p)) for p in s)) for s in sections)), sections


def plain_near(a, b):
    """Likeness and differing paragraphs, by comparing the texts' cuts themselves."""
    same, ours, theirs, places = 0, set(), set(), []
    for i in range(max(len(a[1]), len(b[1]))):
        x, y = (t[1][i] if i < len(t[1]) else None for t in (a, b))
        if x == y:
            same += sum(map(len, x))
            continue
        for j in range(max(len(x or []), len(y or []))):
            p, q = (s[j] if s is not None and j < len(s) else None for s in (x, y))
            if p == q:
                same += len(p)
            else:
                ours |= set(p or [])
                theirs |= set(q or [])
                places.append(f"{i}.{j}")
    total = 2 * same + len(ours) + len(theirs)
    near = min((2 * same + 2 * len(ours & theirs)) / total if total else 0.0, 1 - 1 / (total + 2))
    return 1.0 if a[0] == b[0] else near, " ".join(places)


def test_fingerprints(spark, odd_docs, odd_rows):
    documents = {(i, t or "") for i, t in odd_rows} | {(1, "another text\nof the same id")}
    docs = odd_docs.unionByName(spark.createDataFrame([(1, "another text\nof the same id")], "doc_id bigint, text string"), True)
    keys = spark.createDataFrame(sorted(documents, key=repr), "i bigint, t string").withColumn("h", F.xxhash64("i", "t")).collect()
    order = [(r.i, r.t) for r in sorted(keys, key=lambda r: (r.i is None, -(r.i or 0), r.h))]
    rows = merkle.fingerprints_with_edits(docs).collect()
    assert len(rows) == len(odd_rows) + 1
    wanted = []
    for (i, text), (j, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        mine, other, following = plain_tree(text), plain_tree(edited), plain_tree(after)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        near, places = plain_near(mine, other)
        row = (i, len(text), sha, mine[0], other[0], round(near, 9), round(plain_near(mine, following)[0], 9), places, j)
        wanted += [row] * (sum((k, t or "") == (i, text) for k, t in odd_rows) or 1)
    found = [(*r[:5], round(r[5], 9), round(r[6], 9), r[7], r[8]) for r in rows]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_one_document_follows_itself(spark, no_docs):
    one = spark.createDataFrame([(5, "abc. def")], "doc_id bigint, text string")
    r = merkle.fingerprints_with_edits(one).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"abc.abc.").hexdigest()
    assert merkle.fingerprints_with_edits(no_docs).count() == 0


def test_differing_branches_locate_the_edit(spark):
    rows = spark.createDataFrame([("a\nb\n\nc\nd\n\ne", "a\nb\n\nc\nX\n\ne\nf")], "x string, y string")
    trees = rows.select(merkle.merkle_tree(F.col("x")).alias("a"), merkle.merkle_tree(F.col("y")).alias("b"))
    found = trees.select(merkle.edited_branches(F.col("a"), F.col("b"))).first()[0]
    assert [tuple(p) for p in found] == [(1, 1), (2, 1)]


# WARC


def test_archives(spark, tmp_path):
    rows = [
        (1, "http://a/\r\nx", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 9),
        (5, "u", "é" * 9), (None, "u", "<p>same</p>"), (6, "u", "z" * 300_000), (9, "u", "<p>same</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("x"))
    path = str(tmp_path / "archive")
    warc.write_archives(pages, path)
    found = warc.read_archives(spark, path, payloads=True).collect()
    assert len(found) == len(rows)
    top = {}
    for i, _, html in rows:
        if i is not None:
            top[html or ""] = max(top.get(html or "", i), i)
    wanted = []
    for i, _, html in rows:
        raw = (html or "").encode()
        refers = top[html or ""] if i is not None and i < top[html or ""] else None
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        wanted.append((i, len(raw), digest, "response" if refers is None else "revisit", refers))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(wanted, key=key)
    by_digest = {(r["payload_digest"], r["record_type"]): r["payload"] for r in found}
    assert all((payload is None) == (kind == "revisit") for (_, kind), payload in by_digest.items())
    first = next((tmp_path / "archive").glob("part-*")).read_bytes()
    assert int.from_bytes(first[:4], "little") == warc.DICTIONARY_FRAME


def test_the_sessions_bound_on_records_cuts_no_archive(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), "id").alias("html"))
        warc.write_archives(pages, str(tmp_path / "archive"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert warc.read_archives(spark, str(tmp_path / "archive")).count() == 40


def test_archives_end_at_a_bound_of_bytes(spark, tmp_path):
    r = random.Random(8)
    texts = {k: "".join(chr(r.randrange(33, 126)) for _ in range(30_000 if k % 97 == 0 else r.randrange(400))) for k in range(900)}
    pages = spark.createDataFrame([(k, "u", t) for k, t in texts.items()], "page_id bigint, url string, html string")
    path = tmp_path / "archive"
    warc.write_archives(pages.coalesce(1), str(path), archive_bytes=20_000)
    files = [f.read_bytes() for f in path.glob("part-*")]
    assert len(files) > 10
    for data in files:  # each is read without the others, and is no longer than its bound and a record
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY_FRAME
        assert len(data) - 8 - size <= 20_000 + 31_000 + 8 * warc.ARCHIVE_ROWS
        assert all(raw.startswith(b"WARC/1.1\r\n") for raw in warc.records_of(data))
    found = warc.read_archives(spark, str(path), payloads=True).collect()
    assert {r["page_id"]: (r["payload"] or b"").decode() for r in found if r["record_type"] == "response"} | {
        r["page_id"]: texts[r["page_id"]] for r in found if r["record_type"] == "revisit"
    } == texts
    assert len(found) == 900


def test_rows_of_an_archive():
    for sizes in ([5] * 1000, [1000] * 300, [1] * 5000, [7, 1000, 3] * 200):
        chunks, rows = warc.Chunks(b"H", 640), []
        for n in sizes:
            for out in chunks.add(b"x" * n):
                rows += out
        rows += chunks.rest()
        assert sum(row.count(b"x") for row in rows) == sum(sizes)
        for k in range(0, len(rows), warc.ARCHIVE_ROWS):
            archive = rows[k : k + warc.ARCHIVE_ROWS]
            assert archive[0].startswith(b"H") and b"".join(archive).count(b"H") == 1
            assert sum(map(len, archive)) <= 640 + max(sizes) + 1


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# Packing


def padding(bounds, lengths, counts):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    r = random.Random(3)
    for _ in range(400):
        n = r.randint(1, 8)
        lengths, counts, k = sorted(r.sample(range(40), n)), [r.randint(1, 9) for _ in range(n)], r.randint(1, 6)
        found = packing.optimal_buckets(lengths, counts, k)
        best = min(
            padding(c + (lengths[-1],), lengths, counts)
            for m in range(min(k, n)) for c in combinations(lengths[:-1], m)
        )
        assert found.padding == best == padding(found.lengths, lengths, counts) and len(found.lengths) <= k


def test_boundaries_of_long_texts_are_optimal(spark):
    r = random.Random(11)
    for trial in range(4):
        lengths = [16_385] * 300 + [16_400] + r.choices(range(16_300, 90_000), k=6) + r.choices(range(9), k=40)
        k = r.randint(2, 4)
        docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, w bigint")
        distinct = sorted(set(lengths))
        counts = [lengths.count(n) for n in distinct]
        best = min(
            padding(c + (distinct[-1],), distinct, counts) for m in range(k) for c in combinations(distinct[:-1], m)
        )
        assert sum(r["padding"] for r in packing.pack(docs, F.col("w"), buckets=k).collect()) == best
    docs = spark.createDataFrame([(i, 16_385) for i in range(1000)] + [(1000, 16_400), (1001, None)], "doc_id bigint, w bigint")
    assert sum(r["padding"] for r in packing.pack(docs, F.col("w"), buckets=3).collect()) == 0


def test_batches(odd_docs, odd_rows, no_docs):
    found = packing.pack(odd_docs.select("doc_id", "batch", F.size(words_of(text_of())).alias("w")), F.col("w"), buckets=4, budget=1000)
    rows = found.collect()
    assert len(rows) == len(odd_rows)
    batches = {}
    for r in rows:
        assert r["n_tokens"] == r["w"] and r["padding"] == r["bucket_length"] - r["n_tokens"] >= 0
        batches.setdefault(r["batch"], []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for group in batches.values():
        assert len({r["bucket"] for r in group}) == 1
        assert len(group) == 1 or len(group) * group[0]["bucket_length"] <= 1000
        assert sorted(r["place"] for r in group) == list(range(len(group)))
    assert packing.pack(no_docs.select("doc_id", F.lit(1).alias("w")), F.col("w")).count() == 0


# Jaccard join


def plain_components(rows, words, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        size = min(words, len(w))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set())
    found = signature_tree.UnionFind(len(rows))
    for i, j in combinations(range(len(rows)), 2):
        if rows[i][0] is None or rows[j][0] is None:
            continue
        both = len(sets[i] & sets[j])
        if rows[i][0] == rows[j][0] or both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            found.join(i, j)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            k = found.find(i)
            least[k] = min(least.get(k, own), own)
    return sorted(
        ((own, len(sets[i]), least.get(found.find(i)) if own is not None else None) for i, (own, _) in enumerate(rows)),
        key=repr,
    )


def families(seed, bases, copies, length, changes):
    r = random.Random(seed)
    rows, own = [], 0
    shared = [f"p{k}" for k in range(25)]
    for b in range(bases):
        base = [f"b{b}w{r.randrange(400)}" for _ in range(length)]
        if b % 2:
            base[3:3] = shared  # a passage that many texts have
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randrange(changes)):
                text[r.randrange(len(text))] = f"c{r.randrange(10**6)}"
            rows.append((own, " ".join(text)))
            own += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent,words", [(90, 3), (80, 5)])
def test_components(spark, monkeypatch, percent, words):
    monkeypatch.setattr(jaccard_join, "CHUNK_RECORDS", 7)  # families take several units of their leader
    monkeypatch.setattr(jaccard_join, "CELL_RECORDS", 30)  # and what is left open of the larger ones several cells
    rows = families(1, 6, 60, 90, 8) + [(5000 + k, t) for k, (_, t) in enumerate(families(2, 30, 3, 12, 2))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = jaccard_join.near_duplicates(docs, words, percent).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_components(rows, words, percent)


def test_one_id_with_texts_of_unlike_sizes(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_RECORDS", 2)
    monkeypatch.setattr(jaccard_join, "CELL_RECORDS", 3)
    rows = families(5, 3, 25, 60, 9)
    long = families(6, 1, 12, 200, 12)
    rows += [(k, t) for k, (_, t) in enumerate(long)]  # ids of the short texts, once more
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((tuple(r) for r in jaccard_join.near_duplicates(docs).collect()), key=repr)
    assert found == plain_components(rows, 3, 90)


def test_units_meet_across_labels_and_sizes(spark):
    """A large component beside a few others: its own pairs are left out, all pairs across of linking sizes are met."""
    ids = [(k, 7, k // 90 if k < 90 else k, 100 + k % 3 if k != 99 else 300) for k in range(100)]
    frame = spark.createDataFrame(ids, "id bigint, block bigint, label bigint, n bigint")
    blocks = frame.select("id", F.col("block").alias("label"))
    old = jaccard_join.CELL_RECORDS
    jaccard_join.CELL_RECORDS = 20
    try:
        units = jaccard_join.block_units(blocks, frame.select("id", "label"), frame.select("id", "n"), 90).collect()
    finally:
        jaccard_join.CELL_RECORDS = old
    label, size, members = {r[0]: r[2] for r in ids}, {r[0]: r[3] for r in ids}, {}
    for u in units:
        members.setdefault((u["low"], u["high"]), []).append((u["id"], u["cell"]))
    met = set()
    for (low, high), rows in members.items():
        for (a, x), (b, y) in combinations(rows, 2):
            if low == high or x != y:
                met.add((min(a, b), max(a, b)))
    wanted = {
        (a, b) for a, b in combinations(range(100), 2)
        if label[a] != label[b] and 10 * min(size[a], size[b]) >= 9 * max(size[a], size[b])
    }
    assert wanted <= met
    assert not any(label[a] == label[b] for a, b in met)
    assert len(units) < 100 * 5


def test_components_of_odd_rows(odd_docs, odd_rows, no_docs):
    found = sorted((tuple(r) for r in jaccard_join.near_duplicates(odd_docs).collect()), key=repr)
    assert found == plain_components(odd_rows, 3, 90)
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_tree_loses_no_link():
    r = np.random.default_rng(4)
    for trial in range(8):
        base = [r.choice(2**60, size=int(r.integers(20, 400)), replace=False).astype(np.uint64) for _ in range(6)]
        sets = []
        for k in range(240):
            own = base[k % 6]
            keep = r.random(len(own)) > r.choice((0.0, 0.02, 0.06, 0.2))
            more = r.choice(2**60, size=int(r.integers(0, 4))).astype(np.uint64)
            sets.append(np.unique(np.concatenate([own[keep], more])))
        found, plain = signature_tree.UnionFind(240), signature_tree.UnionFind(240)
        signature_tree.link(sets, np.arange(240), None, 90, found)
        for i, j in combinations(range(240), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                plain.join(i, j)
        assert [found.find(i) for i in range(240)] == [plain.find(i) for i in range(240)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 400)], "a bigint, b bigint")
    found = {r["id"]: r["label"] for r in connected_components(edges).collect()}
    assert found == {**{k: 0 for k in range(101)}, 400: 400, 500: 400}
