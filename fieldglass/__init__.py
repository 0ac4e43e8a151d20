"""Spark-first discourse analytics engine."""
