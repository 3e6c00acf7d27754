"""The question log of FIXTURES F5."""

from conftest import LOW_CUTOFFS, pairs_of
from veilgraph.operators import skew
from veilgraph.operators.graph import build_graph
from veilgraph.plans.questions import answer_questions, question_parameters, route_questions
from veilgraph.plans.traverse import neighbour_table

# question -> intent and the answer on the graph below
ASKED = [
    ("How many nodes?", "node_count", "13"),
    ("How many edges?", "edge_count", "12"),
    ("How many connections does node 0 have?", "degree", "9"),
    ("how many neighbors does 7 have", "degree", "1"),
    ("node 99 degree", "degree", "0"),
    ("What label is node 0?", "label", "Executive"),
    ("node 99 what is it", "label", "not found"),
    ("How many Executive nodes?", "label_count", "1"),
    ("How many Employee nodes?", "label_count", "0"),
    ("BFS from node 0 depth 2", "bfs", "9"),
    ("bfs from 1", "bfs", "9"),
    ("bfs from 10 depth 9", "bfs", "2"),
    ("reachable from 99", "bfs", "0"),
    ("Can node 0 reach node 500?", "pair", "NO (within 4 hops)"),
    ("Can node 1 reach node 2?", "pair", "YES"),
    ("Is there a path between 1 and 1", "pair", "YES"),
    ("Find Executive BROADCAST Inactive", "pattern", "7"),
    ("Find Influencer FOLLOWS Person", "pattern", "0"),
    ("number of nodes labelled Executive", "node_count", "13"),
    ("How many friends does node 0 have?", "fallback", "?"),
    ("how many SEND does node 42 have", "fallback", "?"),
    ("node 99999999999999999999999 degree", "degree", "0"),
    ("", "fallback", "?"),
]
EDGES = [(0, i) for i in range(1, 10)] + [(1, 2), (10, 11), (11, 12)]


def test_log(spark, monkeypatch):
    monkeypatch.setattr(skew, "HUB_ROWS", 5)
    graph = build_graph(pairs_of(spark, EDGES), LOW_CUTOFFS)
    asked = [(n, q) for n, (q, _, _) in enumerate(ASKED)] + [(1000 + n, ASKED[5][0]) for n in range(20)]
    log = spark.createDataFrame(asked, "qid bigint, question string")
    found = {r.qid: (r.intent, r.result) for r in answer_questions(log, graph, neighbour_table(graph)).collect()}
    assert len(found) == len(asked)
    for n, (question, intent, result) in enumerate(ASKED):
        assert found[n] == (intent, result), question
    assert all(found[1000 + n] == ("label", "Executive") for n in range(20))


def test_parameters(spark):
    log = spark.createDataFrame([(1, "bfs from 4 depth 9"), (2, "bfs from 4"), (3, "find a_b send cD\nx")], "qid bigint, question string")
    found = {r.qid: r for r in question_parameters(route_questions(log)).collect()}
    assert (found[1].node, found[1].depth, found[2].depth) == (4, 3, 2)
    assert (found[3].src_label, found[3].edge_label, found[3].dst_label) == ("A_b", "SEND", "Cd")


# question -> intent, node, other, depth, label: every branch of every rule, worked out by hand
BRANCHES = [
    ("total nodes please", "node_count", None, None, None, None),
    ("count nodes", "node_count", None, None, None, None),
    ("total edges", "edge_count", None, None, None, None),
    ("number of edges", "edge_count", None, None, None, None),
    ("degree of node 5", "degree", 5, None, None, None),
    ("neighbors of node 6", "degree", 6, None, None, None),
    ("the connections at node 7", "degree", 7, None, None, None),
    ("node 5 degree", "degree", 5, None, None, None),
    ("node 6 and its neighbors", "degree", 6, None, None, None),
    ("node 7: connections", "degree", 7, None, None, None),
    ("how many neighbors does 8 have", "degree", 8, None, None, None),
    ("how many connections does 9 have", "degree", 9, None, None, None),
    ("label of node 3", "label", 3, None, None, None),
    ("type of node 4", "label", 4, None, None, None),
    ("role for node 5", "label", 5, None, None, None),
    ("node 3 label", "label", 3, None, None, None),
    ("node 4 type", "label", 4, None, None, None),
    ("node 5 role", "label", 5, None, None, None),
    ("node 6 what is it", "label", 6, None, None, None),
    ("count the Manager ones", "label_count", None, None, None, "Manager"),
    ("how many external people", "label_count", None, None, None, "External"),
    ("bfs from 3", "bfs", 3, None, 2, None),
    ("bfs from node 3 depth 1", "bfs", 3, None, 1, None),
    ("reach from 5", "bfs", 5, None, 2, None),
    ("reachable from node 5 depth 3", "bfs", 5, None, 3, None),
    ("reachability from 6 depth 7", "bfs", 6, None, 3, None),
    ("can 1 reach 2", "pair", 1, 2, None, None),
    ("does node 3 reach node 4", "pair", 3, 4, None, None),
    ("is 5 able to reach 6", "pair", 5, 6, None, None),
    ("path from 1 to 2", "pair", 1, 2, None, None),
    ("path between 3 and 4", "pair", 3, 4, None, None),
    ("find one more thing", "pattern", None, None, None, None),
    ("hello", "fallback", None, None, None, None),
]


def test_each_branch(spark):
    log = spark.createDataFrame([(n, row[0]) for n, row in enumerate(BRANCHES)], "qid bigint, question string")
    found = {r.qid: r for r in question_parameters(route_questions(log)).collect()}
    for n, (question, *want) in enumerate(BRANCHES):
        r = found[n]
        assert [r.intent, r.node, r.other, r.depth, r.label] == want, question
