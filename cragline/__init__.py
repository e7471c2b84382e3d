"""Cragline: source-quality analytics as Spark DataFrame queries."""
