"""Anomaly analytics over event logs, written as Spark DataFrame jobs."""
