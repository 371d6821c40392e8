"""Dependency-graph analytics as declarative Spark plans."""
