"""The registered queries of the text operators, with SQL where SQL can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.base import ORACLE, QUERIES, query, table  # noqa: F401  (the entry reads the registry here)
from veilgraph.llm.dataset_manifest import LEAF_COLUMNS, TAMPER_MODULUS, dataset_manifest
from veilgraph.llm.html_text import main_text
from veilgraph.llm.jaccard_join import near_duplicates
from veilgraph.llm.merkle import LEAF, fingerprints_with_edits
from veilgraph.llm.oracle_parts import CRC_TABLE, crc32_sql
from veilgraph.llm.packing import pack
from veilgraph.llm.quality_model import fit_quality, score_quality
from veilgraph.llm.quality_rules import STOP_WORDS, quality_rules
from veilgraph.llm.sentencepiece_ids import encode_decode
from veilgraph.llm.spelling import DELETE_MODULUS, MIN_COUNT, MIN_LENGTH, RATIO, spelling_variants
from veilgraph.llm.substring_dedup import WIDTH, remove_repeats
from veilgraph.llm.token_counts import token_counts
from veilgraph.llm.toxicity import fit_toxicity, score_toxicity
from veilgraph.llm.warc import archive_round_trip

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    "op6_quality_rules",
    f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(3)) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(ws, lambda w: list_contains({_list([*STOP_WORDS, *map(str.capitalize, STOP_WORDS)])}, w))) AS stops
  FROM d LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.1
    AND stops / n_words >= 0.05 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM v""",
)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=False)


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


# Base 32 of a SHA-1: five hexadecimal digits make four of its digits.
_SHA1_BASE32 = """array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT
      >> (15 - 5 * (k % 4))) % 32, 1)), '')"""


@query(
    "op5_warc",
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT t, max(page_id) AS top FROM p GROUP BY t),
r AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h, top FROM p JOIN g USING (t))
SELECT page_id, payload_bytes, {_SHA1_BASE32} AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM r""",
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


@query("op4_html_text")
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _tree_sql(text: str) -> str:
    """Sections of paragraphs of leaves, each node with its hash."""
    leaves = f"list_transform(regexp_extract_all(p, '{LEAF}'), lambda l: sha256('l' || l))"
    paragraphs = f"list_transform(string_split(s, chr(10)), lambda p: {leaves})"
    named = "list_transform(s, lambda p: {'p': sha256('p' || coalesce(array_to_string(p, ''), '')), 'ls': p})"
    sections = f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: {paragraphs})"
    inner = f"list_transform({sections}, lambda s: {named})"
    return f"list_transform({inner}, lambda s: {{'s': sha256('s' || array_to_string(list_transform(s, lambda p: p.p), '')), 'ps': s}})"


def _root_sql(tree: str) -> str:
    return f"sha256('r' || array_to_string(list_transform({tree}, lambda s: s.s), ''))"


def _short(leaves: str) -> str:
    return f"list_transform({leaves}, lambda h: substr(h, 1, 15))"


def _compared_sql(a: str, b: str) -> str:
    """A struct for each pair of branches: equal leaves, other leaves of both, place."""
    none = "[]::VARCHAR[]"
    pa, pb = f"{a}[i + 1].ps[j + 1]", f"{b}[i + 1].ps[j + 1]"
    paragraph = f"""CASE WHEN {pa}.p IS NOT DISTINCT FROM {pb}.p
      THEN {{'same': len({pa}.ls), 'ours': {none}, 'theirs': {none}, 'place': NULL::VARCHAR}}
      ELSE {{'same': 0, 'ours': coalesce({_short(f"{pa}.ls")}, {none}), 'theirs': coalesce({_short(f"{pb}.ls")}, {none}), 'place': i || '.' || j}} END"""
    inside = f"list_transform(range(greatest(coalesce(len({a}[i + 1].ps), 0), coalesce(len({b}[i + 1].ps), 0))), lambda j: {paragraph})"
    whole = f"[{{'same': len(flatten(list_transform({a}[i + 1].ps, lambda p: p.ls))), 'ours': {none}, 'theirs': {none}, 'place': NULL::VARCHAR}}]"
    section = f"CASE WHEN {a}[i + 1].s IS NOT DISTINCT FROM {b}[i + 1].s THEN {whole} ELSE {inside} END"
    return f"flatten(list_transform(range(greatest(len({a}), len({b}))), lambda i: {section}))"


def _summed_sql(parts: str) -> str:
    ours, theirs = (f"list_distinct(flatten(list_transform({parts}, lambda x: x.{side})))" for side in ("ours", "theirs"))
    places = f"list_filter(list_transform({parts}, lambda x: x.place), lambda x: x IS NOT NULL)"
    return f"""{{'same': list_sum(list_transform({parts}, lambda x: x.same))::BIGINT, 'ours': {ours}, 'theirs': {theirs},
    'places': coalesce(array_to_string({places}, ' '), '')}}"""


def _near_sql(root_a: str, root_b: str, found: str) -> str:
    total = f"(2 * {found}.same + len({found}.ours) + len({found}.theirs))"
    both = f"(2 * {found}.same + 2 * len(list_intersect({found}.ours, {found}.theirs)))"
    share = f"CASE WHEN {total} > 0 THEN 1.0::DOUBLE * {both} / {total} ELSE 0.0::DOUBLE END"
    return f"CASE WHEN {root_a} = {root_b} THEN 1.0::DOUBLE ELSE least({share}, 1.0::DOUBLE - 1.0::DOUBLE / ({total} + 2)) END"


@query(
    "op1_fingerprints",
    f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT doc_id, t, n, coalesce(lead(t) OVER o, first_value(t) OVER o) AS nt,
  coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS nd FROM d WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT doc_id, t, n, nt, nd, substr(t, 1, n - n // 2) || substr(nt, 1, n // 2) AS et FROM x),
l AS (SELECT doc_id, n, et, nd, {_tree_sql("t")} AS tl, {_tree_sql("et")} AS el, {_tree_sql("nt")} AS nl FROM e),
c AS (SELECT *, {_root_sql("tl")} AS tr, {_root_sql("el")} AS er, {_root_sql("nl")} AS nr,
  {_compared_sql("tl", "el")} AS pe, {_compared_sql("tl", "nl")} AS pn FROM l),
r AS (SELECT doc_id, n, et, nd, tr, er, nr, {_summed_sql("pe")} AS we, {_summed_sql("pn")} AS wn FROM c)
SELECT doc_id, n::BIGINT AS n_chars, sha256(et) AS edited_sha256, tr AS fingerprint, er AS edited_fingerprint,
  {_near_sql("tr", "er", "we")} AS near_edited, {_near_sql("tr", "nr", "wn")} AS near_next, we.places AS edited_branches, nd AS next_doc_id
FROM r""",
)
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(table(spark, sf_dir, "documents"))


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_pieces")
    return pack(sized, F.col("n_pieces")).drop("n_pieces")


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


# Lower-cases A to Z only; a shingle is a list of words.
_LOWER_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x20\\x09-\\x0D]+')"
)


@query(
    "op10_jaccard_join",
    f"""
WITH RECURSIVE w AS (SELECT doc_id, {_LOWER_WORDS} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, ws[i : i + 2] AS g FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * k >= 90 * (p.n + q.n - k)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(least.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.x = w.doc_id""",
)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_HASHED = " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in LEAF_COLUMNS
)
# The next node: of two, of a last one alone, and of a step of a path.
_PARENTS = "list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
_STEP = "sha256(CASE WHEN p[1] = 'L' THEN p[2:] || h WHEN p[1] = 'R' THEN h || p[2:] ELSE h END)"
_SIBLING = "CASE WHEN xor(spot, 1) >= len(nodes) THEN '' ELSE CASE WHEN (spot & 1) = 1 THEN 'L' ELSE 'R' END || nodes[xor(spot, 1) + 1] END"


@query(
    "op11_dataset_manifest",
    f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, source, lang, text, n_chars, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g,
  doc_id IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % {TAMPER_MODULUS} = 0 AS hit FROM documents, crc),
h AS (SELECT doc_id, g, sha256({_HASHED}) AS leaf,
  CASE WHEN hit THEN sha256({_HASHED.replace("n_chars", "(n_chars + 1)")}) ELSE sha256({_HASHED}) END AS changed FROM d),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS rid FROM h),
tree(g, k, nodes) AS (SELECT g, 0, list(leaf ORDER BY pos) FROM l GROUP BY g
  UNION ALL SELECT g, k + 1, {_PARENTS} FROM tree WHERE len(nodes) > 1),
subs AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS rank FROM tree WHERE len(nodes) = 1),
over_(k, nodes) AS (SELECT 0, list(subroot ORDER BY rank) FROM subs
  UNION ALL SELECT k + 1, {_PARENTS} FROM over_ WHERE len(nodes) > 1),
steps AS (SELECT rid, k, {_SIBLING} AS p FROM (
    SELECT rid, k, nodes, pos >> k AS spot FROM l JOIN tree USING (g) WHERE len(nodes) > 1
    UNION ALL SELECT rid, 1000 + k, nodes, rank >> k FROM l JOIN subs USING (g), over_ WHERE len(nodes) > 1)),
paths AS (SELECT rid, list(p ORDER BY k) AS path FROM steps GROUP BY rid),
f AS (SELECT doc_id, leaf, changed, subroot, (SELECT nodes[1] FROM over_ WHERE len(nodes) = 1) AS root,
  coalesce(path, []::VARCHAR[]) AS path FROM l JOIN subs USING (g) LEFT JOIN paths USING (rid))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda p: p[2:]), ''), '')) AS proof_sha256,
  list_reduce(path, lambda h, p: {_STEP}, changed) AS folded_root,
  list_reduce(path, lambda h, p: {_STEP}, changed) = root AS verified
FROM f""",
)
def op11_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_manifest(table(spark, sf_dir, "documents"))


@query(
    "op12_spelling_variants",
    f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''),
    '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]{{{MIN_LENGTH},}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
k AS (SELECT id || ':' || run AS s, run, count(*) AS c FROM r GROUP BY id, run),
h AS (SELECT run, c, {crc32_sql("s")} AS lot FROM k, crc),
w AS (SELECT CASE WHEN lot % {DELETE_MODULUS} = 0 THEN run[: lot % length(run)] || run[lot % length(run) + 2 :] ELSE run END AS word, c FROM h),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
cut AS MATERIALIZED (SELECT word, n, i, word[: i - 1] AS a, word[i + 1 :] AS b
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
less AS (SELECT DISTINCT cut.word, cut.n, v.word AS other, v.n AS m FROM cut JOIN v ON v.word = a || b),
near AS (SELECT x.word, x.n, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT * FROM less UNION ALL SELECT other, m, word, n FROM less),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS top, max(m) AS top_n FROM near GROUP BY word),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top_n >= {RATIO} * n THEN top END AS form,
  CASE WHEN top_n >= {RATIO} * n THEN top_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain(word, tip, form) AS (SELECT word, word, form FROM f
  UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.form)
SELECT f.word, f.form, chain.tip AS root, n, n_near, form_n FROM f JOIN chain ON chain.word = f.word WHERE chain.form IS NULL""",
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


@query(
    "op13_substring_dedup",
    f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS ws FROM documents),
win AS (SELECT rid, i, md5(array_to_string(ws[i : i + {WIDTH - 1}], ' ')) AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS i FROM d WHERE len(ws) >= {WIDTH})),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT rid, i + k AS i FROM dup, (SELECT unnest(range({WIDTH})) AS k)),
each AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS s FROM each ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)""",
)
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
