"""The hand file of FIXTURES F1 in both modes, plain and gzip."""

import gzip

import pytest

from conftest import pairs_of, rows
from veilgraph.operators.graph import build_graph, derive_nodes, drop_self_loops, normalise_undirected
from veilgraph.sources.edge_list import scan_edge_list

TEXT = "# comment\n0 1\n1 0\n1\t2\n2 2\n\n3 4 99\n5\nx 6\n"


@pytest.fixture
def path(tmp_path):
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "edges.txt").write_text(TEXT)
    (tmp_path / "gz").mkdir()
    with gzip.open(tmp_path / "gz" / "edges.txt.gz", "wt") as f:
        f.write(TEXT)
    return tmp_path


def _graph(found):
    edges = normalise_undirected(drop_self_loops(found.edges))
    return rows(derive_nodes(edges)), rows(edges)


@pytest.mark.parametrize("kind", ["plain", "gz"])
def test_strict(spark, path, kind):
    found = scan_edge_list(spark, str(path / kind), "strict")
    assert _graph(found) == ([(0,), (1,), (2,)], [(0, 1), (1, 2)])
    assert rows(found.rejects) == [("3 4 99", "token count"), ("5", "token count"), ("x 6", "not an integer")]


@pytest.mark.parametrize("kind", ["plain", "gz"])
def test_lenient(spark, path, kind):
    found = scan_edge_list(spark, str(path / kind), "lenient")
    assert _graph(found) == ([(i,) for i in range(5)], [(0, 1), (1, 2), (3, 4)])
    assert rows(found.rejects) == [("x 6", "not an integer")]


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "e.txt").write_bytes(b"1 2\n\xff\xfe 3\n4 5\n")
    found = scan_edge_list(spark, str(tmp_path), "strict")
    assert rows(found.edges) == [(1, 2), (4, 5)]
    assert found.rejects.count() == 1


def test_unknown_mode(spark, path):
    with pytest.raises(ValueError):
        scan_edge_list(spark, str(path / "plain"), "loose")


def test_empty_graph_is_an_error(spark):
    with pytest.raises(ValueError):
        build_graph(pairs_of(spark, [(3, 3)]))
