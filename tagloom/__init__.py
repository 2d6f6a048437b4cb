"""Audit and correction of catalogue metadata as Spark DataFrame jobs."""
