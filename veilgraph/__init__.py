"""Protected labelled-graph analytics expressed as Spark DataFrame jobs."""
