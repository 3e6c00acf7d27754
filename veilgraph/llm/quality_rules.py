"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Every rule bounds the ratio of two counts of the text.  The counts are column
expressions over arrays of the row, so the operator is one narrow projection:
no shuffle, no Python, and a row needs memory in proportion to its own text.

Defined results: a null text counts as empty; a text without words has zero
counts and fails the base rule; a ratio over zero is null and breaks no rule;
repeated rows are scored each; columns of the input that share a name with an
output column are replaced by it; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.llm.base import WORD, bind, text_of, words_of

SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the and of to in is was that with this for are not it be by on as at from or "
    "le la les de des du et un une est dans que qui pour pas sur avec par au en "
    "der die das und ist ein eine nicht mit von zu den im auf für dem sich auch an "
    "el los las y que con del por una para se no al lo como su es"
).split()


@dataclass(frozen=True)
class Rule:
    """``part / whole`` must lie in [low, high]; a bound of None does not bind."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None


# Thresholds of the production run: lenient, so that only text far from prose breaks one.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=14.0),
    Rule("symbols", "n_symbols", "n_words", high=0.10),
    Rule("stop_words", "n_stop_words", "n_words", low=0.05),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.50),
)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are sorted by hash, and equal hashes by the words themselves, so equal windows are always
    neighbours; the words decide.  Texts of which all hashes differ are done without sorting.
    """

    def window(at: Column, k: int) -> Column:
        return F.get(words, at + F.lit(k))

    def hashed(i: Column) -> Column:
        return F.xxhash64(window(i, 0), window(i, 1), window(i, 2))

    def repeated_places(hashes: Column) -> Column:
        def placed(h: Column, i: Column) -> Column:
            return F.struct(h.alias("h"), *[window(i, k).alias(f"w{k}") for k in range(3)], i.alias("i"))

        def same(a: Column, b: Column) -> Column:
            return reduce(lambda x, y: x & y, (a[name] == b[name] for name in ("h", "w0", "w1", "w2")))

        def twins(ordered: Column) -> Column:
            # A null neighbour makes the comparison null, which a filter drops.
            kept = F.filter(ordered, lambda x, k: same(x, F.get(ordered, k + 1)) | same(x, F.get(ordered, k - 1)))
            return F.transform(kept, lambda x: x["i"])

        return bind(F.sort_array(F.transform(hashes, placed)), twins)

    def covered(places: Column) -> Column:
        """Windows start at ``places``; each adds the words up to the next start, three at most."""
        reach = F.transform(
            places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3))).cast("long")
        )
        return F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)

    def counted(hashes: Column) -> Column:
        unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
        found = bind(F.sort_array(repeated_places(hashes)), covered)
        return F.when(unique, F.lit(0).cast("long")).otherwise(found)

    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda _, i: hashed(i))
    return bind(hashes, counted)


def _counts(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Every count that a rule may name."""
    def found(pattern: str) -> Column:
        return F.size(F.regexp_extract_all(text, F.lit(pattern), 0))

    return {
        "n_words": F.size(words),
        "word_chars": F.length(F.concat_ws("", words)),
        "n_symbols": found(f"[{SYMBOLS}]"),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin([*STOP_WORDS, *map(str.capitalize, STOP_WORDS)]))),
    }


def quality_rules(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    column: str = "text",
) -> DataFrame:
    """``docs`` with its counts, ``base_failed``, ``broken`` (names of broken rules) and ``kept``."""

    def lines_of(text: Column) -> Column:
        return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))

    def measured(text: Column) -> Column:
        return bind(words_of(text), lambda words: bind(lines_of(text), lambda lines: packed(text, words, lines)))

    def packed(text: Column, words: Column, lines: Column) -> Column:
        counts = _counts(text, words, lines)
        return F.struct(*[value.cast("long").alias(name) for name, value in counts.items()])

    def judged(m: Column) -> Column:
        too_repeated = 100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"]
        failed = (m["n_words"] < min_words) | too_repeated
        verdicts = []
        for rule in rules:
            ratio = m[rule.part] / F.nullif(m[rule.whole], F.lit(0))
            inside = F.lit(True)
            if rule.low is not None:
                inside = inside & (ratio >= rule.low)
            if rule.high is not None:
                inside = inside & (ratio <= rule.high)
            verdicts.append(F.when(~F.coalesce(inside, F.lit(True)), F.lit(rule.name)))
        broken = F.array_compact(F.array(*verdicts)) if verdicts else F.array().cast("array<string>")
        names = list(_counts(F.lit(""), F.array(), F.array()))
        return F.struct(
            *[m[name].alias(name) for name in names],
            failed.alias("base_failed"),
            broken.alias("broken"),
            (~failed & (F.size(broken) == 0)).alias("kept"),
        )

    result = bind(bind(text_of(column), measured), judged)
    held = "_quality_rules"
    while held in docs.columns:
        held = f"_{held}"
    scored = docs.withColumn(held, result)
    fields = scored.schema[held].dataType.names
    others = [F.col(f"`{c}`") for c in docs.columns if c not in fields]
    return scored.select(*others, *[F.col(f"{held}.{name}") for name in fields])
