"""Declarative data quality on Spark."""
