"""Dependency-graph, contract-gate and workflow-event analytics on Spark DataFrames."""
