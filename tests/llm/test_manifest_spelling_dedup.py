"""The versioned manifest, spelling variants and substring deduplication against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilgraph.llm import dataset_manifest, recompression, spelling, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(row, add=0):
    n = row["n_chars"]
    values = (row["doc_id"], row["source"], row["lang"], None if n is None else n + add, row["text"])
    return sha(*map(plain_field, values))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def plain_manifest(rows):
    """The whole tree is built again for every tampered leaf."""
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        leaves[g] = [plain_leaf(r) for r in groups[g]]

    def whole(changed):
        subroots = [plain_levels(changed.get(g, leaves[g]))[-1][0] for g in order]
        return subroots, plain_levels(subroots)

    subroots, top = whole({})
    out = []
    for rank, g in enumerate(order):
        levels = plain_levels(leaves[g])
        for place, r in enumerate(groups[g]):
            proof, at = [], place
            for nodes in levels[:-1]:
                proof += nodes[at ^ 1 : (at ^ 1) + 1]
                at >>= 1
            at = rank
            for nodes in top[:-1]:
                proof += nodes[at ^ 1 : (at ^ 1) + 1]
                at >>= 1
            folded = top[-1][0]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                folded = whole({g: leaves[g][:place] + [plain_leaf(r, 1)] + leaves[g][place + 1 :]})[1][-1][0]
            out.append((r["doc_id"], leaves[g][place], subroots[rank], top[-1][0], sha(*proof), folded, folded == top[-1][0]))
    return out


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, root string, grp string, pos string"


def manifest_docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest(spark, odd_rows, levels):
    r = random.Random(levels)
    rows = [(i, t, r.choice([None, "en", "", "é", "zz", "0"]), None if i == 4 else "web", None if i == 7 else 5) for i, t in odd_rows]
    rows += [(i, f"text {i}", r.choice(["en", "en", "fr"]), "web", i) for i in range(100, 190)]
    rows.append((500, "alone", "lone", None, 1))
    docs = manifest_docs(spark, rows)
    found = dataset_manifest.dataset_manifest(docs, block_levels=levels)
    wanted = plain_manifest([{"doc_id": i, "text": t, "lang": g, "source": s, "n_chars": n} for i, t, g, s, n in rows])
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))
    assert any(not w[-1] for w in wanted)


def test_versions_copy_ancestors_only(spark):
    docs = manifest_docs(spark, [(i, f"text {i}", "en", "web", i) for i in range(37)])
    found = {r["doc_id"]: r for r in dataset_manifest.dataset_manifest(docs, nodes=True, block_levels=2).collect()}
    base = plain_levels([found[i]["leaf"] for i in range(37)])
    for i, r in found.items():
        tampered = zlib.crc32(str(i).encode()) % 7 == 0
        assert (r["version"] is not None) == tampered
        if not tampered:
            continue
        changed = plain_leaf({"doc_id": i, "source": "web", "lang": "en", "n_chars": i, "text": f"text {i}"}, 1)
        again = plain_levels([found[k]["leaf"] if k != i else changed for k in range(37)])
        differing = [n for a, b in zip(again, base) for n, m in zip(a, b) if n != m]
        assert differing == [changed, *r["version"]]


def test_manifest_of_one_and_of_none(spark):
    one = dataset_manifest.dataset_manifest(manifest_docs(spark, [(3, "a", "en", None, 1)])).collect()
    assert len(one) == 1 and one[0]["root"] == one[0]["leaf"] and one[0]["proof_sha256"] == sha()
    assert dataset_manifest.dataset_manifest(manifest_docs(spark, [])).count() == 0


# Spelling


def apart_by_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_vocabulary(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    rows = {}
    for w, n in words.items():
        near = [v for v in words if apart_by_one(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        rows[w] = (form, n, len(near), words[form] if form else None)

    def root(w):
        return root(rows[w][0]) if rows[w][0] else w

    return sorted((w, f or "", root(w), n, near, m or 0) for w, (f, n, near, m) in rows.items())


def found_variants(frame):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in frame.collect())


@pytest.mark.parametrize("block_words", [1, 3, 4096])
def test_variants_of_crowded_words(spark, block_words):
    r = random.Random(block_words)
    words = {"".join(r.choices("abé", k=r.randint(7, 9))): r.choice([2, 3, 40, 500]) for _ in range(260)}
    words |= {"a" * k: 2 ** (3 * k - 18) for k in range(7, 12)} | {"prefix" + x: 2 for x in "abcdefg"}
    texts = [(i, " ".join([w.upper() if i % 2 and w.isascii() else w] * n)) for i, (w, n) in enumerate(words.items())]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    frame = spelling.spelling_variants(docs, block_words=block_words)
    assert found_variants(frame) == plain_variants(plain_vocabulary(texts))


def test_variants_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    assert found_variants(spelling.spelling_variants(odd_docs)) == plain_variants(plain_vocabulary(odd_rows))
    assert spelling.spelling_variants(no_docs).count() == 0


def test_ties_and_chains(spark):
    text = " ".join(["abcdefgh"] * 2 + ["abcdefgi"] * 20 + ["abcdefgj"] * 20 + ["abcdefgii"] * 200 + ["×÷abcdefg"] * 2)
    rows = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame([(None, text)], "doc_id bigint, text string")).collect()}
    wanted = plain_variants(plain_vocabulary([(None, text)]))
    assert found_variants(spelling.spelling_variants(spark.createDataFrame([(None, text)], "doc_id bigint, text string"))) == wanted
    assert rows["abcdefgh"]["form"] == "abcdefgi" and rows["abcdefgh"]["root"] == "abcdefgii"


def test_position_index_is_edit_distance_one():
    r = random.Random(4)
    words = sorted({"".join(r.choices("ab", k=r.randint(0, 6))) for _ in range(90)})
    index = spelling.PositionIndex(words)
    for w in words:
        sets = index.near(w, last=True)
        found = sorted(words[i] for s in sets for i in range(len(words)) if s >> i & 1)
        assert found == sorted(v for v in words if apart_by_one(w, v))


# Substring deduplication


def plain_dedup(rows, width):
    texts = [WORD.findall(t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), words in zip(rows, texts):
        gone = {i + k for i in range(len(words) - width + 1) if counts[tuple(words[i : i + width])] > 1 for k in range(width)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def passages(seed, width):
    """Texts that share passages around the width, periodic ones, and copies that differ in a word."""
    r = random.Random(seed)

    def some(n, of=4000):
        return [str(r.randrange(of)) for _ in range(n)]

    shared = [some(width + k) for k in (-1, 0, 1, 20, 90)]
    rows = []
    for i in range(60):
        words = some(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            words += r.choice(shared) + some(r.randint(0, 5))
        rows.append((i, " ".join(words)))
    long = some(300)
    for i in range(20):
        copy = list(long)
        copy[r.randrange(300)] = "changed"
        rows.append((100 + i, "  ".join(copy)))
    rows += [(200, "a b " * 50), (201, "b a " * 40 + "c"), (202, "a " * width), (203, "a " * (width - 1)), (204, " ".join(some(400, 2)))]
    return rows + [rows[3], (None, rows[4][1]), (None, None), (5, ""), (5, rows[65][1])]


@pytest.mark.parametrize("width", [4, 35])
def test_removed_words(spark, monkeypatch, width):
    monkeypatch.setattr(substring_dedup, "HUB_ROWS", 5)
    rows = passages(width, width)
    docs = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], "doc_id bigint, text string, doc string, n_words string, marks string")
    found = substring_dedup.remove_repeats(docs, width)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_dedup(rows, width)


def test_removed_words_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    assert sorted(map(tuple, substring_dedup.remove_repeats(odd_docs).collect()), key=repr) == plain_dedup(odd_rows, 35)
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_signature_and_anchor_depend_on_the_window_alone(monkeypatch):
    r = random.Random(9)
    for _ in range(60):
        width, kinds = r.choice([3, 5, 35]), r.choice([2, 4, 40])
        texts = [" ".join(str(r.randrange(kinds)) for _ in range(r.randint(0, 160))) for _ in range(5)]
        texts += [texts[0][4:] + " x " + texts[1], "a " * 50]
        monkeypatch.setattr(substring_dedup, "PIECE_WORDS", r.choice([20, 100, 100_000]))
        seen = {}
        for pieces in substring_dedup.text_pieces(enumerate(texts), width):
            owner, first, here, found = pieces.windows()
            for o, f, at, s, a, p in zip(owner, first, here, found.signature, found.anchor, found.place):
                window = tuple(WORD.findall(texts[o])[f : f + width])
                assert seen.setdefault(window, (s, a, p - at)) == (s, a, p - at)
                assert 0 <= p - at < width
        assert len({s for s, _, _ in seen.values()}) == len(seen)


def test_word_hashes_name_words(monkeypatch):
    r = random.Random(2)
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", 50)
    seen = {}
    for _ in range(300):
        text = "".join(r.choices("abcé日\x00 \t\n\x0b\x1c\xa0", k=r.randint(0, 200)))
        words, hashes = WORD.findall(text), substring_dedup.word_hashes(text)
        assert len(words) == len(hashes) and words == [w.decode() for w in text.encode().split()]
        for w, h in zip(words, hashes.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) > 1000


def test_rounds_name_runs_and_pairs():
    words = np.array([5, 5, 5, 7, 5, 5], np.uint64)
    runs = recompression.name_runs(recompression.Symbols.of(words, np.zeros(6, bool)))
    assert runs.length.tolist() == [3, 1, 2] and runs.symbols.names[1] == 7
    assert len(set(runs.symbols.names.tolist())) == 3 and runs.symbols.starts.tolist() == [0, 3, 4, 6]
    left = np.array([True, False, True])
    pairs, place = recompression.name_pairs(runs.symbols, left)
    assert place.tolist() == [0, 0, 1] and pairs.starts.tolist() == [0, 4, 6]
