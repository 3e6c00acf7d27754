"""Registry of queries and the SQL that computes the same rows from the plain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.base import Workspace, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    """Register ``fn(workspace)`` under ``name`` with its SQL."""

    def register(fn: Callable[[Workspace], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(workspace(spark, sf_dir))
        ORACLE[name] = sql
        return fn

    return register


def pad(r: str) -> str:
    share = f"CASE WHEN {r} < 1000 THEN 0.2::DOUBLE WHEN {r} < 5000 THEN 0.15::DOUBLE ELSE 0.1::DOUBLE END"
    return f"(CASE WHEN {r} = 0 THEN 0 ELSE {r} + greatest(1, CAST(ceil({r} * ({share})) AS BIGINT)) END)"


def workers(r: str) -> str:
    return f"(CASE WHEN {r} < 500 THEN 1 WHEN {r} < 2000 THEN 2 WHEN {r} < 5000 THEN 4 ELSE 8 END)"


def pieces(degree: str, rows: int) -> str:
    return f"greatest(1, CAST(ceil({degree} / {rows}.0::DOUBLE) AS BIGINT))"


def piece(nbr: str, degree: str, rows: int) -> str:
    return f"({spread(nbr)}) % {pieces(degree, rows)}"


def spread(nbr: str) -> str:
    return f"(({nbr} % 2147483647) * 48271 + (({nbr} // 2147483647) * 16807) % 2147483647) % 2147483647"


_GRAPH = """
raw AS (
  SELECT 1000000000 + o_custkey u, 2000000000 + l_suppkey v
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 2000000000 + l_suppkey, 3000000000 + l_partkey FROM lineitem
  UNION ALL SELECT 4000000000 + c_nationkey::BIGINT, 1000000000 + c_custkey FROM customer
  UNION ALL SELECT 4000000000 + s_nationkey::BIGINT, 2000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 2000000000 + min(l_suppkey), 2000000000 + max(l_suppkey)
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey
  UNION ALL SELECT a, b FROM (SELECT 4000000000 + n_nationkey::BIGINT a,
      4000000000 + lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT b FROM nation)
    WHERE b IS NOT NULL
  UNION ALL SELECT 1000000000 + o_custkey, 5000000000 + o_orderkey FROM orders),
pairs AS MATERIALIZED (SELECT DISTINCT least(u, v) u, greatest(u, v) v FROM raw WHERE u <> v),
nodes AS MATERIALIZED (
  SELECT id, count(*) degree, CASE WHEN count(*) > 500 THEN 'Executive' WHEN count(*) > 200 THEN 'Manager'
      WHEN count(*) > 50 THEN 'Employee' WHEN count(*) > 5 THEN 'External' ELSE 'Inactive' END AS label
  FROM (SELECT u id FROM pairs UNION ALL SELECT v FROM pairs) GROUP BY id),
edges AS MATERIALIZED (
  SELECT p.u, p.v, a.label u_label, b.label v_label, a.degree u_degree, b.degree v_degree,
    CASE WHEN a.label IN ('Executive', 'Manager') AND b.label IN ('Executive', 'Manager') THEN 'REPLY'
         WHEN a.label IN ('Executive', 'Manager') THEN 'BROADCAST'
         WHEN a.label = b.label THEN 'INTERNAL' ELSE 'SEND' END AS label
  FROM pairs p JOIN nodes a ON a.id = p.u JOIN nodes b ON b.id = p.v),
sym AS (SELECT u id, v nbr, label lbl, u_label label, v_label nbr_label, u_degree degree FROM edges
  UNION ALL SELECT v, u, label, v_label, u_label, v_degree FROM edges),
hist AS (SELECT label, 'v' kind, id, NULL::BIGINT u, NULL::BIGINT v FROM nodes
  UNION ALL SELECT label, 'e', NULL, u, v FROM edges),
counts AS (SELECT label, count(*) r FROM hist GROUP BY label),
ordered AS (SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) - 1 AS place, count(*) OVER () AS n FROM nodes),
starts AS (SELECT CASE c WHEN 0 THEN 'high' WHEN 1 THEN 'mid' ELSE 'low' END AS class, id, degree
  FROM ordered, (SELECT unnest([0, 1, 2]) c)
  WHERE place = CASE c WHEN 0 THEN 0 WHEN 1 THEN n // 4 ELSE n - 1 END),
store AS (SELECT id, label, degree, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS total FROM nodes)
"""


def graph_sql(select: str, *ctes: str) -> str:
    """``select`` over the graph's tables; ``ctes`` are further named queries."""
    return "WITH " + ",\n".join([_GRAPH.strip(), *ctes]) + "\n" + select


def level_ctes(seeds: str, depth: int) -> list[str]:
    """l0 .. l<depth>: (seed, node) first reached at that distance from each row of ``seeds`` (seed)."""
    out = [f"l0 AS MATERIALIZED (SELECT DISTINCT seed, seed AS node FROM ({seeds}) JOIN nodes ON id = seed)"]
    for d in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT seed, node FROM l{i}" for i in range(d))
        out.append(
            f"l{d} AS MATERIALIZED (SELECT DISTINCT f.seed, s.nbr AS node FROM l{d - 1} f JOIN sym s ON s.id = f.node "
            f"WHERE NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.seed = f.seed AND b.node = s.nbr))"
        )
    reached = " UNION ALL ".join(f"SELECT {d} AS depth, seed, node FROM l{d}" for d in range(depth + 1))
    out.append(f"reached AS MATERIALIZED ({reached})")
    out.append("per_level AS (SELECT seed, depth, count(*) n FROM reached GROUP BY seed, depth)")
    return out


def level_rows(seeds: str, depth: int) -> str:
    """(seed, depth, frontier_r, new_nodes, visited) for depth 1..; needs ``level_ctes``."""
    return (
        f"SELECT s.seed, d.depth, "
        f"coalesce((SELECT n FROM per_level p WHERE p.seed = s.seed AND p.depth = d.depth - 1), 0) AS frontier_r, "
        f"coalesce((SELECT n FROM per_level p WHERE p.seed = s.seed AND p.depth = d.depth), 0) AS new_nodes, "
        f"coalesce((SELECT sum(n) FROM per_level p WHERE p.seed = s.seed AND p.depth <= d.depth), 0)::BIGINT AS visited "
        f"FROM (SELECT DISTINCT seed FROM ({seeds})) s, (SELECT unnest(range(1, {depth + 1}))::INT depth) d"
    )
