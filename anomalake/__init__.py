"""Anomaly scoring and evaluation over record and vector tables, as Spark DataFrame queries."""
