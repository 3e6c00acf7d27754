"""The run log: events read as measured runs."""

from __future__ import annotations

from pyspark.sql import functions as F

RUNS_SQL = """WITH runs AS (SELECT event_id, event_type AS label,
  CASE user_id % 3 WHEN 0 THEN 'padded' WHEN 1 THEN 'double' ELSE 'plain' END AS scheme,
  CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS k,
  CAST(1 + user_id % 3 AS INT) AS depth, value AS t_total_ms FROM events)"""


def run_log(w):
    """(event_id, label, scheme, k, depth, t_total_ms)."""
    user = F.col("user_id") % 3
    step = F.get_json_object("props", "$.k").cast("bigint") % 4
    return w.table("events").select(
        "event_id",
        F.col("event_type").alias("label"),
        F.when(user == 0, "padded").when(user == 1, "double").otherwise("plain").alias("scheme"),
        F.when(step == 0, 1).when(step == 1, 2).when(step == 2, 4).otherwise(8).alias("k"),
        (1 + user).cast("int").alias("depth"),
        F.col("value").alias("t_total_ms"),
    )
