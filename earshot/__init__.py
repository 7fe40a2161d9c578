"""Listening-history analytics on Spark: imports, entity matching, rollups, statistics, streaming."""
