"""Trace-intervention analytics on Spark."""
