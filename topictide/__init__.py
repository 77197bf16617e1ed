"""Temporal topic analytics as Spark DataFrame jobs."""
