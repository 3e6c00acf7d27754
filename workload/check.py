"""Run registered queries and their SQL side by side; report rows, columns and values."""

from __future__ import annotations

import glob
import os
import time

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, float):
        return round(value, 9)
    return value


def normal(table) -> list[tuple]:
    """Rows of an Arrow table, columns by name, rows in a total order."""
    columns = sorted(table.column_names)
    rows = zip(*[[_plain(v) for v in table.column(c).to_pylist()] for c in columns])
    return sorted((tuple(r) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir) -> dict:
    began = time.time()
    found = fn(spark, sf_dir).toArrow()
    spent = time.time() - began
    out = {"query": name, "rows": found.num_rows, "seconds": round(spent, 2)}
    wanted = con.execute(sql).to_arrow_table()
    types = {
        c: (str(found.schema.field(c).type), str(wanted.schema.field(c).type))
        for c in set(found.column_names) & set(wanted.column_names)
        if found.schema.field(c).type != wanted.schema.field(c).type
    }
    same_columns = sorted(found.column_names) == sorted(wanted.column_names)
    out["columns"] = same_columns
    out["types"] = types
    a, b = normal(found), normal(wanted) if same_columns else []
    out["match"] = same_columns and a == b
    if not out["match"]:
        out["wanted_rows"] = wanted.num_rows
        out["columns_found"], out["columns_wanted"] = sorted(found.column_names), sorted(wanted.column_names)
        out["only_spark"] = [r for r in a if r not in set(b)][:3] if len(a) < 200000 else []
        out["only_sql"] = [r for r in b if r not in set(a)][:3] if len(b) < 200000 else []
    return out
