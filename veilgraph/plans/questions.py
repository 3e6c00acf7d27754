"""A log of plain-language questions, routed and answered in bulk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.crypto import evaluated_once
from veilgraph.functions.roles import NODE_LABELS
from veilgraph.operators.graph import Graph
from veilgraph.operators.skew import Dimension, attach
from veilgraph.plans.pattern import TRIPLE, triple_counts
from veilgraph.plans.traverse import PAIR_HOPS, NeighbourTable, bfs_reachable_count, reachable_pairs
from veilgraph.runtime import save

# The phrases and patterns that decide what a (lower-cased)
# question asks for, the default and greatest depth, and the answers' wording.
NODE_COUNT = ("how many nodes", "count nodes", "total nodes", "number of nodes")
EDGE_COUNT = ("how many edges", "count edges", "total edges", "number of edges")
DEGREE = (
    r"(?:degree|neighbors|connections).*?node\s+(\d+)|node\s+(\d+).*?(?:degree|neighbors|connections)",
    r"how many (?:neighbors|connections) does (?:node\s+)?(\d+)",
)
LABEL = r"(?:label|type|role).*?node\s+(\d+)|node\s+(\d+).*?(?:label|type|role|what is)"
COUNT_WORDS = ("how many", "count", "number")
BFS = (
    r"bfs\s+from\s+(?:node\s+)?(\d+)(?:\s+depth\s+(\d+))?",
    r"reach(?:able|ability)?\s+from\s+(?:node\s+)?(\d+)(?:\s+depth\s+(\d+))?",
)
PAIR = (
    r"(?:can|does|is).*?(?:node\s+)?(\d+).*?reach.*?(?:node\s+)?(\d+)",
    r"path.*?(?:from|between).*?(\d+).*?(?:to|and).*?(\d+)",
)
PATTERN = r"find\s+(\w+)\s+(\w+)\s+(\w+)"
DEFAULT_DEPTH, GREATEST_DEPTH = 2, 3
NOT_FOUND, YES, NO, UNKNOWN = "not found", "YES", "NO (within 4 hops)", "?"


def _any(text: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def _rx(pattern: str) -> Column:
    # (?d): only \n ends a line for the dot.
    return F.lit("(?d)" + pattern)


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, "(?d)" + pattern, group), F.lit(""))


def _first_matching(text: Column, patterns, group: int) -> Column:
    """The group of the first pattern that matches; a later pattern is not asked then."""
    return F.when(F.regexp_like(text, _rx(patterns[0])), _group(text, patterns[0], group)).otherwise(
        _group(text, patterns[1], group)
    )


def route_questions(questions: DataFrame) -> DataFrame:
    """Add ``intent`` to (qid, question); the first rule that applies wins."""
    q = F.lower("question")
    intent = (
        F.when(_any(q, NODE_COUNT), "node_count")
        .when(_any(q, EDGE_COUNT), "edge_count")
        .when(F.regexp_like(q, _rx(DEGREE[0])) | F.regexp_like(q, _rx(DEGREE[1])), "degree")
        .when(F.regexp_like(q, _rx(LABEL)), "label")
        .when(_any(q, [n.lower() for n in NODE_LABELS]) & _any(q, COUNT_WORDS), "label_count")
        .when(F.regexp_like(q, _rx(BFS[0])) | F.regexp_like(q, _rx(BFS[1])), "bfs")
        .when(F.regexp_like(q, _rx(PAIR[0])) | F.regexp_like(q, _rx(PAIR[1])), "pair")
        .when(F.regexp_like(q, _rx(PATTERN)), "pattern")
        .otherwise("fallback")
    )
    # The rules are used by every parameter; they are evaluated once.
    return questions.select("*", evaluated_once(intent, "intent"))


def question_parameters(routed: DataFrame) -> DataFrame:
    """Add node, other, depth, label, src_label, edge_label, dst_label; NULL where not asked for."""
    q = F.lower("question")
    intent = F.col("intent")

    def only(name: str, value: Column) -> Column:
        return F.when(intent == name, value)

    degree = F.when(
        F.regexp_like(q, _rx(DEGREE[0])),
        F.coalesce(_group(q, DEGREE[0], 1), _group(q, DEGREE[0], 2)),
    ).otherwise(_group(q, DEGREE[1], 1))
    label_id = F.coalesce(_group(q, LABEL, 1), _group(q, LABEL, 2))
    node = F.coalesce(
        only("degree", degree),
        only("label", label_id),
        only("bfs", _first_matching(q, BFS, 1)),
        only("pair", _first_matching(q, PAIR, 1)),
    )
    asked_depth = F.coalesce(_first_matching(q, BFS, 2).cast("decimal(38,0)"), F.lit(DEFAULT_DEPTH))
    named = F.coalesce(*[F.when(q.contains(n.lower()), F.lit(n)) for n in NODE_LABELS])
    return routed.withColumns(
        {
            "node": node.try_cast("bigint"),
            "other": only("pair", _first_matching(q, PAIR, 2)).try_cast("bigint"),
            "depth": only("bfs", F.least(asked_depth, F.lit(GREATEST_DEPTH)).cast("int")),
            "label": only("label_count", named),
            "src_label": only("pattern", F.initcap(_group(q, PATTERN, 1))),
            "edge_label": only("pattern", F.upper(_group(q, PATTERN, 2))),
            "dst_label": only("pattern", F.initcap(_group(q, PATTERN, 3))),
        }
    )


_PARAMETERS = ("node", "other", "depth", "label", "src_label", "edge_label", "dst_label")


def _answers(asked: DataFrame, graph: Graph, table: NeighbourTable) -> DataFrame:
    """(key, result) of the distinct questions (key, intent, parameters)."""

    def of(intent: str) -> DataFrame:
        return asked.filter(F.col("intent") == intent)

    def text(column) -> Column:
        return column.cast("string").alias("result")

    zero = F.lit(0).cast("bigint")
    nodes, edges = graph.nodes, graph.edges
    n_nodes = nodes.agg(F.count(F.lit(1))).scalar()
    n_edges = edges.agg(F.count(F.lit(1))).scalar()
    by_id = nodes.select(F.col("id").alias("node"), "degree", F.col("label").alias("_found"))
    by_label = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    by_triple = triple_counts(graph)

    bfs = of("bfs").select("key", F.col("node").alias("seed"), "depth")
    pairs = of("pair").select("key", F.col("node").alias("src"), F.col("other").alias("dst"))
    reached = bfs_reachable_count(bfs, nodes, table, GREATEST_DEPTH)
    joined = reachable_pairs(pairs.filter("src IS NOT NULL AND dst IS NOT NULL"), nodes, table, PAIR_HOPS)
    parts = [
        of("node_count").select("key", text(n_nodes)),
        of("edge_count").select("key", text(n_edges)),
        of("degree").join(by_id, "node", "left").select("key", text(F.coalesce("degree", zero))),
        of("label").join(by_id, "node", "left").select("key", text(F.coalesce("_found", F.lit(NOT_FOUND)))),
        of("label_count").join(by_label, "label", "left").select("key", text(F.coalesce("n", zero))),
        bfs.join(reached, ["seed", "depth"], "left").select("key", text(F.coalesce("reachable", zero))),
        pairs.join(joined, ["src", "dst"], "left").select(
            "key", F.when(F.col("reachable"), F.lit(YES)).otherwise(F.lit(NO)).alias("result")
        ),
        of("pattern").join(by_triple, list(TRIPLE), "left").select("key", text(F.coalesce("n", zero))),
        of("fallback").select("key", F.lit(UNKNOWN).alias("result")),
    ]
    return reduce(DataFrame.unionByName, parts)


def answer_questions(questions: DataFrame, graph: Graph, table: NeighbourTable) -> DataFrame:
    """(qid, intent, result) for a whole log.

    Equal questions are answered once: the log is reduced to its distinct
    parameter sets with their counts, and the answers are joined back, a
    question asked very often by broadcast.
    """
    parsed = question_parameters(route_questions(questions))
    key = F.concat_ws("|", "intent", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _PARAMETERS])
    parsed = save(parsed.withColumn("key", key).drop("question"), "questions")
    asked = save(parsed.groupBy("key", "intent", *_PARAMETERS).agg(F.count(F.lit(1)).alias("times")), "asked")
    answers = _answers(asked, graph, table).join(asked.select("key", "times"), "key")
    dim = Dimension.of(save(answers, "answers"), "key", "times")
    scatter = F.concat(F.lit("~"), F.xxhash64("qid").cast("string"))
    return attach(parsed.select("qid", "intent", "key"), "key", dim, {"result": "result"}, scatter).drop("key")
