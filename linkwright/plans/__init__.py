"""Compositions of operators: linkage pipelines and driver-table fixtures."""
